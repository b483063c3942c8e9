"""A PySpark engine for event-discovery and document-extraction tables."""
