"""Operators for training data: cleaning, matching, budgeting and mixing of text corpora."""
