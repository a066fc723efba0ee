"""linkstrata: a PySpark engine for vector-retrieval evaluation and dataset auditing."""
