"""Column functions: text, times, commands and paths, redaction."""
