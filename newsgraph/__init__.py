"""newsgraph: news-event analytics as plain DataFrame functions on PySpark."""
