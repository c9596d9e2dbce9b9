"""Language, binding and planning."""
