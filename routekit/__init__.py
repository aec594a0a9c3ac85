"""routekit: utility-route survey analytics on Spark DataFrames."""
