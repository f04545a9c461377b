"""Folders that fill up, as streams."""
