"""Column expressions: escapes, lexing, classification of cells."""
