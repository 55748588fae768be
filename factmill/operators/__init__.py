"""operators of factmill."""
