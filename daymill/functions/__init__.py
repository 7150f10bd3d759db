"""Column functions: text, time, redaction and similarity expressions."""
