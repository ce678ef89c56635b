"""Access-graph analytics on Spark: who can reach what, through which groups, policies, tags and lineage."""
