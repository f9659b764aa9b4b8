"""Stream, sketch, graph, logic and time-series analytics on PySpark."""
