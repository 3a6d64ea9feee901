"""corpusloom: scholarly-corpus analytics expressed as Spark DataFrame and SQL operators."""
