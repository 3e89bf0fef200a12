"""palabre: cohort-and-event analytics on Spark DataFrames."""
