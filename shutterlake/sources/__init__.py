"""Readers and writers for listings, pair lists, tag tables and reports."""
