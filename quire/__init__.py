"""quire: document-corpus analytics as Spark relations."""
