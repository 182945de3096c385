"""Set-at-a-time analytics over meeting transcripts and the records around them, on Spark DataFrames."""
