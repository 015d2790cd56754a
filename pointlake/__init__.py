"""pointlake: laser-scanning point clouds as ordinary Spark DataFrames."""
