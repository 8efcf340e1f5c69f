"""corpusmill: text-corpus analytics as declarative Spark plans."""
