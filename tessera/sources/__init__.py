"""Delimited files, change archives, row loaders and table functions."""
