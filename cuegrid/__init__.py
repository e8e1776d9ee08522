"""Analytics over timed transcripts on Spark: DataFrame and Column functions, in batch and as streams."""
