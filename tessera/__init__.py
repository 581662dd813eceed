"""tessera: a Spark-first analytics engine (SQL, object queries, JSON paths, change streams)."""
