"""millrace: decision-support and auction-stream analytics written as Spark DataFrames."""
