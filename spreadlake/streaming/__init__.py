"""Structured Streaming forms of the bar builder, signal state and risk monitor."""
