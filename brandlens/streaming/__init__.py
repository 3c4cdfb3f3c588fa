"""Streaming extension of the share-of-voice metrics."""
