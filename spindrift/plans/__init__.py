"""Whole plans: the registered queries, the staged pipeline and its command line."""
