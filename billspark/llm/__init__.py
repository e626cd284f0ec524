"""Operators for large text corpora: identifiers, tokens, licences, near duplicates, filters."""
