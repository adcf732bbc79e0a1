"""Point-in-time panel preparation and binary scoring on Spark DataFrames."""
