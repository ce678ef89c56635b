"""Ordered statements and requests that reconcile desired with observed state."""
