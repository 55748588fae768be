"""streaming of factmill."""
