"""Reading delimited text and writing results."""
