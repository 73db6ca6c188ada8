"""Column expressions: text rules and request-log rules."""
