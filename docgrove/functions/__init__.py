"""Text analysis, the text query language and ranking."""
