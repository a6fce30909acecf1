"""A PySpark engine for code-change datasets and vector retrieval."""
