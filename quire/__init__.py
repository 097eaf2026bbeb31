"""Documents, tables, pages, pixels and frames as Spark DataFrames."""
