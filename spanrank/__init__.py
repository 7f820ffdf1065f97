"""Section-scoped retrieval over a corpus, as Spark plans."""
