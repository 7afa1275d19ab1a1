"""Structured Streaming variants of the trajectory measures."""
