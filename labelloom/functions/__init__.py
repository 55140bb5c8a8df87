"""Column expressions: text, labels, prompts, token arrays."""
