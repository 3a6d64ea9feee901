"""Stateful operators as Structured Streaming queries over event tables."""
