"""The queries the driver runs, with their fixtures and reference SQL."""
