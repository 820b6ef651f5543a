"""The same lexer on streams of files."""
