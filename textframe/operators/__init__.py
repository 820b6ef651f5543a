"""Operators on loaded frames and on raw files: levels, codes, diagnostics."""
