"""Column expressions. All of them are built-in functions, so they run within generated code."""
