"""kvloom: ordered key-value data, versioned maps and document search on Spark DataFrames."""
