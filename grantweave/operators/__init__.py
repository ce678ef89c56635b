"""Relational and graph operators over the access graph."""
