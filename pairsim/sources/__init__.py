from pairsim.sources.tables import read_table, read_tables  # noqa: F401
