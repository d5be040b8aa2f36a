"""Column functions: normalisation, code-likeness, categories, text preparation."""
