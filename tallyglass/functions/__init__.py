"""Column builders: predicates, windows, URLs, classifiers, statistics."""
