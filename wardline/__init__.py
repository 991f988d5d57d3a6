"""wardline: risk-scoring analytics over user tables and a social graph, on Spark DataFrames."""
