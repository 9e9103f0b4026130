"""Readers and writers, and the schemas they use."""
