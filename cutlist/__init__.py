"""Timed-transcript and clip analytics on PySpark."""
