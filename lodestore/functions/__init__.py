"""Column functions: vector metrics, keys and text."""
