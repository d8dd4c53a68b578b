"""Whole refresh runs over a warehouse folder, and the read packs over its tables."""
