"""tessera: multi-label analysis of labelled symbol-sequence pairs, as Spark jobs."""

__version__ = "0.1.0"
