"""Column expressions for findings, names, versions and vectors."""
