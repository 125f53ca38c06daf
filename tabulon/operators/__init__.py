"""Statement nodes to DataFrame plans."""
