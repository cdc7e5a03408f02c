"""Traceloom: evaluation of tool-calling agents' traces as Spark DataFrames."""
