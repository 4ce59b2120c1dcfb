"""Structured Streaming jobs: push intake, queue drain, status counts."""
