"""Whole reports, put together from the operators."""
