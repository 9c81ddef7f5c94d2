"""Operators of a training-data pipeline (see queries.py for the registered queries)."""
