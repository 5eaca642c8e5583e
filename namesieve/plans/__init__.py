"""Whole runs: the two-party protocol, the benchmark, and the registered queries."""
