"""Intent-conditioned retrieval over a semantic topic graph, as Spark DataFrames."""
