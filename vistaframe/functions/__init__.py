"""Column functions: text, numbers as words, geometry, arrays and losses. No I/O, no Python per row."""
