"""Rules, patterns and recursion over triples as Spark DataFrames."""
