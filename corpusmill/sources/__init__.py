"""Readers and writers of the formats that the corpus comes in and leaves in."""
