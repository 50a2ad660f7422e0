"""Operators for preparing large text corpora; nothing else in strandline imports this package."""
