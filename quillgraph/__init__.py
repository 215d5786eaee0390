"""Long-text corpora, hybrid retrieval and evidence graphs as Spark DataFrame operators."""
