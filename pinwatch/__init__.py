"""Vulnerability exposure analytics as DataFrame and Structured Streaming jobs."""
