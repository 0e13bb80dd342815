"""Column expressions: scores, text, vectors.  All are built-in functions and stay in generated code."""
