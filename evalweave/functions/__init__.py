"""Column expressions: text extraction, scoring, identity and small statistics."""
