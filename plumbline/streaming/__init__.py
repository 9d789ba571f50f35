"""Structured Streaming refresh of reports."""
