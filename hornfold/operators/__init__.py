"""Rule bodies, heads, explanations and set operations as DataFrame expressions."""
