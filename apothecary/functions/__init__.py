"""Column functions: text, names, numbers, vectors and clinical rules, all built from native expressions."""
