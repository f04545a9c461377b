"""Scans: files and markup to relations."""
