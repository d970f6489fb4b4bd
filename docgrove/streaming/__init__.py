"""Streaming maintenance of document tables."""
