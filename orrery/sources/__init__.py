"""Readers of feeds, files and snapshots."""
