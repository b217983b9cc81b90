"""Pipelines of preprocess, encode and interpret steps, and field queries; both only build DataFrame plans."""
