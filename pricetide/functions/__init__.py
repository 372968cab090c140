"""Column functions: text, attributes, fingerprints, predicates, similarity."""
