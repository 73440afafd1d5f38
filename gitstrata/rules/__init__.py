"""Fixed rule tables (data only)."""
