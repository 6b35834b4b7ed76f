"""Column functions: text, URLs, identities, scores, headlines and times."""
