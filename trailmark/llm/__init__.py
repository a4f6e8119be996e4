"""Operators for preparing training text: dedup, scans, mixing, tokenizing, scoring."""
