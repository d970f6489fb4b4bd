"""From expressions and nodes to DataFrame plans."""
