"""Point-in-time analytics and forecast evaluation on Spark DataFrames."""
