"""Traceloom: sources."""
