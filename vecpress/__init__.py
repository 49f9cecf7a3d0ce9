"""Analytics over compressed vectors, Spark first."""
