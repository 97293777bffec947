"""Sources: driver tables, fixture views, instrument lists, message logs."""
