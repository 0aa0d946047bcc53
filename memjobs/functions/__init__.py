"""Column functions: text, parsing, rendering, embedding."""
