"""plans of factmill."""
