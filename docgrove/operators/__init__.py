"""Index specifications and query nodes."""
