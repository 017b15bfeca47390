"""factspark: versioned facts with conjunctive pattern queries, built on Spark DataFrames."""
