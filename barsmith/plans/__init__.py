"""Registered queries: each pairs a Spark plan over the driver tables with an
equivalent DuckDB SQL text (the correctness oracle)."""

from barsmith.plans.registry import REGISTRY, register  # noqa: F401


def load_all():
    """Import every plan module so that their queries register themselves."""
    from barsmith.plans import (q_bars, q_store, q_reports, q_futures,  # noqa: F401
                                q_catalog, q_monitoring, q_recording, q_stream, q_extra, q_kept)
    return REGISTRY
