"""Streaming forms of the alert log: routed alerts and windowed rollups with late data."""
