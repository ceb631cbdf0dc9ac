"""corpusloom: parallel-corpus and training-data operators as Spark plans."""

__all__ = ["session", "schema"]
