"""Streaming upkeep of configuration state."""
