"""Column-level helpers: complex algebra, scalar rules, hash draws."""
