"""Part of chartweave."""
