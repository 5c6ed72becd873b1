"""Tessera: document-grounded retrieval analytics as Spark DataFrame operators."""
