"""Operators for building training corpora; nothing else in idloom imports this package."""
