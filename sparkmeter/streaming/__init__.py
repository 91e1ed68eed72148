"""Structured Streaming jobs over log trees."""
