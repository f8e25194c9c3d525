"""Facts and rules in, facts out."""
