"""Column helpers: text, dates and numbers."""
