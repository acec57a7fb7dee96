"""Column functions: text normalisation, similarity, keys."""
