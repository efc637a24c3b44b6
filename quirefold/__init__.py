"""Document analytics on Spark: pages, blocks, figures, tables and caches as DataFrames."""
