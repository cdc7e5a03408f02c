"""Traceloom: functions."""
