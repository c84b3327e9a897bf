"""Readers and views of input tables."""
