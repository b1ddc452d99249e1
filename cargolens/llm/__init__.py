"""Operators of a training-data pipeline: text, vectors, packing and scoring at corpus scale."""
