"""Readers: SQL, CSV directories, JSON pages, push requests, published deltas, connector specs."""
