"""Reading, writing and maintaining document tables."""
