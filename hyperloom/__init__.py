"""Pattern queries over typed metagraphs and tables, planned into Spark DataFrames."""
