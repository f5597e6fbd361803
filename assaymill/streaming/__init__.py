"""Incremental forms of the batch operators, and event-time windows."""
