"""Column functions: text, money, dates."""
