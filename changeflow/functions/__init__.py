"""Column-level building blocks; every one compiles to built-in expressions."""
