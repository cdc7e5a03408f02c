"""Traceloom: streaming."""
