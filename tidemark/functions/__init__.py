"""Column builders: Columns in, Columns out, no Python UDFs."""
