"""Streams over bronze runs and the request log."""
