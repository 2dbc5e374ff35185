"""Tagging from a message stream: batches, routing, progress and resuming."""
