"""selenogrid: terrain analytics and site selection over gridded lunar cells, on Spark DataFrames."""
