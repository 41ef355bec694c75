"""Readers and writers for landed files and for the five stored tables."""
