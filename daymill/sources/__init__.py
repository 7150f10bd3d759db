"""Readers and writers, and adapters over the sample tables."""
