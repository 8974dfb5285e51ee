"""millrace: a dataflow and query engine expressed as Spark plans."""
