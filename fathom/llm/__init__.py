"""Operators that prepare text for training: classification, deduplication, mixing, extraction, archives."""
