"""Rule metadata and the fixpoint built from the operators."""
