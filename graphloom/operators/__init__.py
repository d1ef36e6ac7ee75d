"""General data-processing operators."""
