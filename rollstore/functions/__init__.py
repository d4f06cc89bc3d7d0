"""Text forms of results."""
