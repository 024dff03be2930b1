"""Text-corpus preparation and hybrid retrieval as Spark DataFrame plans."""
