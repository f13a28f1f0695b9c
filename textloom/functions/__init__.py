"""Column functions: affix classes, tag predicates, 8-bit scores."""
