"""DuckDB SQL fragments shared by oracle queries (the SQL twins of
barsmith.functions)."""


def sg(s: str) -> str:
    """symbol_group (F4) in SQL."""
    t = f"trim({s})"
    bf = f"split_part({t}, '_FUT', 1)"
    return (f"CASE WHEN strpos({t}, '_FUT') > 0 THEN substring({bf}, 1, greatest(length({bf}) - 5, 0)) || '_F' "
            f"WHEN strpos({t}, '_CASH') > 0 THEN 'CASH' "
            f"WHEN strpos({t}, '_FOP') > 0 OR strpos({t}, '_OPT') > 0 THEN substring({t}, 1, greatest(length({t}) - 12, 0)) "
            f"ELSE {t} END")


def ac(s: str) -> str:
    """asset_class (F5) in SQL."""
    return (f"CASE WHEN strpos({s}, '_') > 0 THEN replace(string_split({s}, '_')[-1], 'CASH', 'CSH') "
            f"ELSE 'STK' END")


def is_opt(s: str) -> str:
    return f"right({s}, 3) IN ('OPT', 'FOP')"
