"""tidemill: event and batch analytics on PySpark's DataFrame, SQL and Structured Streaming APIs."""
