"""Column expressions: URLs, strings, times and XML text."""
