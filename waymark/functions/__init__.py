"""Column expressions, one module for each subject."""
