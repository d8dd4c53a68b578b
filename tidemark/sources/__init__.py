"""Landing files, catalog tables and provider JSON."""
