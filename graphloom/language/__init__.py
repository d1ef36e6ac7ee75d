"""The query language: tokens, syntax tree, parser."""
