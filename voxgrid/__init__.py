"""voxgrid: opinion analytics and text-data processing on Spark DataFrames."""
