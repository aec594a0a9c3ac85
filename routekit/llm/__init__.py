"""Operators for text corpora: near-duplicates, decontamination, scoring, quality, licences, secrets, tokens, archives."""
