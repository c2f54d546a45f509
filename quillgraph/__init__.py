"""Analytics on document collections and the knowledge graphs derived from them, as Spark DataFrame functions."""
