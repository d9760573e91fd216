"""Reports over files as they arrive."""
