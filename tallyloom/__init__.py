"""Analytics over agent and product event streams, written as Spark jobs."""
