"""Queries that run each operator over the driver tables, with equivalent DuckDB SQL."""
