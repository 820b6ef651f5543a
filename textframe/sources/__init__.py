"""Reading records from delimited text, and writing frames as delimited text."""
