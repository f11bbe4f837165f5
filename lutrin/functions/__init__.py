"""Scalar functions on text: columns in, columns out."""
