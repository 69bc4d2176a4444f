"""Column functions: text, patterns, JSON pointers, dates, references, digests."""
