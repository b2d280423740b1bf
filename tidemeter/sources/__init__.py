"""Readers that produce the canonical record, and writers for published results."""
