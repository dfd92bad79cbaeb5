"""Relational operators of pipelines."""
