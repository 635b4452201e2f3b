"""Column functions with Unicode-exact text semantics, and vector scores."""
