"""Analytics over web archives as Spark jobs."""
