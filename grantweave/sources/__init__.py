"""Readers that turn exports and configuration files into DataFrames."""
