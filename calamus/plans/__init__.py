"""Composed plans: the same-author protocol, sweeps and the query catalogue."""
