"""Readers and writers for the stored documents; one JSON document per file, many files per table."""
