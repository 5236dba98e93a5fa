"""Column expressions: CIGAR strings, bases, read filters."""
