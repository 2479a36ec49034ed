"""Column helpers and the extension registry."""
