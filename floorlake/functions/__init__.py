"""Column functions: geometry, classification and text."""
