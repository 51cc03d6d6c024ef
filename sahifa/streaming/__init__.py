"""Streaming forms of the resumable steps."""
