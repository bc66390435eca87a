"""Column functions: text cleaning, matching, token arithmetic and references."""
