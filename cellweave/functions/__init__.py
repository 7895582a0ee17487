"""Column functions: text, quantities, similarities."""
