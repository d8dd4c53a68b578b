"""Operators for training-data corpora: deduplication, scoring, scanning, mixing and encoding."""
