"""Column functions: text and addresses."""
