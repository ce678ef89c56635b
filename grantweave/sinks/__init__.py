"""Writers for snapshots, exports and drawings."""
