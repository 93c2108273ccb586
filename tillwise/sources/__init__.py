"""Readers, writers, report tables and the model store."""
