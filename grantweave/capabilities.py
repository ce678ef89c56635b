"""What privileges each kind of asset knows, and which connectors write groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Privileges by connector and asset type.
PRIVILEGES = {
    ("snowflake", "DATABASE"): ["MODIFY", "MONITOR", "USAGE", "CREATE SCHEMA", "OWNERSHIP", "IMPORTED PRIVILEGES", "REFERENCE_USAGE"],
    ("snowflake", "SCHEMA"): [
        "OWNERSHIP", "MODIFY", "MONITOR", "USAGE", "CREATE EXTERNAL TABLE", "CREATE FILE FORMAT", "CREATE FUNCTION", "CREATE MASKING POLICY", "CREATE MATERIALIZED VIEW",
        "CREATE PASSWORD POLICY", "CREATE PIPE", "CREATE PROCEDURE", "CREATE ROW ACCESS POLICY", "CREATE SESSION POLICY", "CREATE SEQUENCE", "CREATE STAGE", "CREATE STREAM",
        "CREATE TAG", "CREATE TABLE", "CREATE TASK", "CREATE VIEW", "ADD SEARCH OPTIMIZATION", "CREATE TEMPORARY TABLE",
    ],
    ("snowflake", "TABLE"): ["OWNERSHIP", "SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "REBUILD"],
    ("snowflake", "VIEW"): ["OWNERSHIP", "SELECT", "REFERENCES", "DELETE", "INSERT", "REBUILD", "TRUNCATE", "UPDATE"],
    ("tableau", "workbook"): [
        "ViewComments", "Filter", "CreateRefreshMetrics", "ChangePermissions", "Read", "Write", "Delete", "ShareView", "ChangeHierarchy", "RunExplainData", "ExportData", "ExportXml",
        "WebAuthoring", "ViewUnderlyingData", "AddComment", "ExportImage",
    ],
    ("tableau", "lens"): ["ChangeHierarchy", "Delete", "Write", "Read", "ChangePermissions"],
    ("tableau", "datasource"): ["Connect", "ChangeHierarchy", "SaveAs", "Delete", "Write", "Read", "ExportXml", "ChangePermissions"],
    ("tableau", "flow"): ["ChangeHierarchy", "Delete", "WebAuthoringForFlows", "Read", "ChangePermissions", "Execute", "Write", "ExportXml"],
    ("tableau", "metric"): ["ChangeHierarchy", "Delete", "Write", "Read", "ChangePermissions"],
    ("tableau", "project"): ["Read", "Write", "ProjectLeader", "InheritedProjectLeader"],
    ("tableau", "view"): ["ViewComments", "Filter", "ChangePermissions", "Read", "Delete", "ShareView", "ExportData", "WebAuthoring", "ViewUnderlyingData", "AddComment", "ExportImage"],
}
#: Connectors that write groups, and whether groups may nest there.
GROUPS = {"snowflake": True, "tableau": False}


def catalogue(spark: SparkSession) -> DataFrame:
    """(connector, asset_type, privilege); capabilities of the BI server come in an Allow and a Deny form."""
    rows = [(c, t, f"{mode}{p}") for (c, t), ps in PRIVILEGES.items() for p in ps for mode in (("Allow", "Deny") if c == "tableau" else ("",))]
    return spark.createDataFrame(rows, "connector string, asset_type string, privilege string")


def group_writers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GROUPS.items()), "connector string, nested boolean")
