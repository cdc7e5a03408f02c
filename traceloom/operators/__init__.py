"""Traceloom: operators."""
