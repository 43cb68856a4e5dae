"""Column functions: text and spans, money, dates, addresses, noise."""
