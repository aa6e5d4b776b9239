"""quirework: a Spark-first engine for document structure and text corpora."""
