"""discweave: Spark-first analytics over menu-driven disc media and large text corpora."""
