"""Column expressions: everything here compiles to built-in Catalyst expressions."""
