"""Text triage and corpus preparation on Spark DataFrames."""
