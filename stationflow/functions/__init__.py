"""Column expressions: time parts, numeric helpers, payload parsing."""
