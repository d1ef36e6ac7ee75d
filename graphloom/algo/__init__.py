"""Graph algorithms and vector search as DataFrame programs."""
