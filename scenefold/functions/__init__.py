"""Column builders and small vectorised helpers."""
