"""Operators for training text and sequences: terms, shared spans, tokenizing, leakage, look-alike text."""
