"""Vector search, passage preparation and training-data operators on Spark DataFrames."""
