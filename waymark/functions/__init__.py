"""Column functions: geography, headings, vectors."""
