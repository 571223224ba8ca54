"""isohyet: station climate analytics on Spark DataFrames."""
