"""Column expressions: text, signals and decisions."""
