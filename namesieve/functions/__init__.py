"""Scalar functions: text, signatures, vectors."""
