"""Graph analytics on sorted sets, and training-data operators, with Spark DataFrames."""
