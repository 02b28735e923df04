"""Column expressions; all native, no Python functions run per row."""
