"""Column expressions: names, dates, series, sheet text."""
