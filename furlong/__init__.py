"""furlong: race-data jobs and training-data operators on Spark DataFrames."""
