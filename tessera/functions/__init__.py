"""Column expressions: geometry, media time, hashes, names."""
