"""Readers and writers of race documents."""
