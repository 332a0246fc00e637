"""Readers and writers: CSV tables, interaction adapters, the graph store."""
