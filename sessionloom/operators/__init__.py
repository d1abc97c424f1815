"""Relational operators: pairing, as-of, multiset difference, numbering."""
