"""SQL-workload analytics on Spark: scripts, plans, catalogs and counters as DataFrames."""
