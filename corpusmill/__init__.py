"""corpusmill: a Spark-first engine for building and auditing problem corpora."""
