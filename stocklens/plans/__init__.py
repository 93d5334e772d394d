"""User-level reports; each function returns a lazy DataFrame."""
