"""Readers, writers and idempotent stores."""
