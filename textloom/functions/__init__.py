"""Column functions: normalization, tokenization and token transformations."""
