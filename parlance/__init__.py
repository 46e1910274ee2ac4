"""Spoken-language analytics on PySpark."""
