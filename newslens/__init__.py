"""newslens: search, timelines and analytics over document collections, on Spark DataFrames."""
