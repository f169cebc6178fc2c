"""folioflow: document import, cleaning, batching and layout as Spark DataFrame operations."""
