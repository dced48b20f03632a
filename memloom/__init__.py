"""memloom: conversational-memory analytics and corpus preparation on Spark DataFrames."""
