"""Structured Streaming forms of the window estimates."""
