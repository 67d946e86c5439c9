"""Website content-cohesion analytics on Spark DataFrames."""
