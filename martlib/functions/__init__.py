"""Column expressions: cleaning, calendar parts, guarded ratios and error measures."""
