"""Column functions with the value semantics that all operators share."""
