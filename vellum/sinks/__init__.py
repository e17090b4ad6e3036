"""Office packages from normalised tables."""
