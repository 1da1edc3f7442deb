"""Symbols, imports and calls of source files, as tables."""
