"""coexnet: weighted co-expression network analysis on Spark."""
