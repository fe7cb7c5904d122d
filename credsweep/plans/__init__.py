"""End-to-end scans and the registered queries."""
