"""Quire: document-corpus analytics on PySpark DataFrames."""
