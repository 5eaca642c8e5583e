"""Operators: scaler, clustering, index, search, selection, metrics, projection."""
