"""Column functions: text, URL, similarity, predicates and image arithmetic."""
