"""Tables of the access graph.

Nodes are keyed by (node_type, node_id), since different types may share a name and so an id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = """node_type string, node_id string, name string, asset_type string, path array<string>,
  connectors array<string>, metadata map<string,string>, identifiers array<struct<kind:string,value:string>>,
  pass_through_hierarchy boolean, pass_through_lineage boolean, privileges array<string>, description string,
  value string, matching_path string, target_type string"""
EDGES = "src_type string, src_id string, dst_type string, dst_id string, edge_type string"
PERMISSIONS = "user_id string, asset_id string, privilege string, mode string, mode_detail string, reasons array<string>, seq bigint"
IDENTITIES = "connector string, local_name string, user_name string"
POLICIES = "asset string, agent_type string, agent string, privileges array<string>, metadata map<string,string>"
DEFAULT_POLICIES = "root string, path string, target_type string, agent_type string, agent string, privileges array<string>, metadata map<string,string>, connector_managed boolean"

#: Edge types and their inverses.
INVERSE = {
    "member_of": "includes",
    "granted_from": "granted_to",
    "child_of": "parent_of",
    "derived_from": "derived_to",
    "tagged_as": "applied_to",
    "untagged_as": "removed_from",
    "governed_by": "governs",
    "received_childrens_default_from": "provided_default_for_children",
    "other": "other",
}
INVERSE |= {v: k for k, v in INVERSE.items()}

#: The order in which node types sort.
NODE_ORDER = ("user", "group", "asset", "policy", "tag", "default_policy")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def inverse_type(edge_type: Column) -> Column:
    return F.element_at(literal_map(INVERSE), edge_type)
