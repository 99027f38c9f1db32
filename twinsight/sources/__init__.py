"""Reading customer tables."""

from twinsight.sources.tables import load_clean, read_table

__all__ = ["load_clean", "read_table"]
