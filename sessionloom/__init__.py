"""Session-log refinery on Spark DataFrames."""
