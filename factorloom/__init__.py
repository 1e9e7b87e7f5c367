"""factorloom: factor-graph analytics expressed as Spark DataFrames."""
