"""Micro-batch loads: watched folders and announcements of files."""
