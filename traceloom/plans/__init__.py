"""Traceloom: plans."""
