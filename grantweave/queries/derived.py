"""The access graph derived from the star schema, as SQL that both engines read.

Each text names the tables it uses in braces. ``Tables`` resolves them in Spark; ``with_clause`` spells them as common table
expressions for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

DERIVED = {
    "hier": """SELECT 'root' AS src, concat('region:', r_regionkey) AS dst FROM {region}
      UNION ALL SELECT concat('region:', n_regionkey), concat('nation:', n_nationkey) FROM {nation}
      UNION ALL SELECT concat('nation:', s_nationkey), concat('supplier:', s_suppkey) FROM {supplier}
      UNION ALL SELECT concat('nation:', c_nationkey), concat('customer:', c_custkey) FROM {customer}""",
    "hier_orders": "SELECT * FROM {hier} UNION ALL SELECT concat('customer:', o_custkey), concat('order:', o_orderkey) FROM {orders}",
    "ring": "SELECT concat('n', n_nationkey) AS src, concat('n', (n_nationkey + 1) % 25) AS dst FROM {nation}",
    "brands": """SELECT DISTINCT p_type AS src, p_brand AS dst FROM {part}
      UNION ALL SELECT DISTINCT p_brand, concat('flag:', l_returnflag) FROM {part} JOIN {lineitem} ON p_partkey = l_partkey
      UNION ALL SELECT DISTINCT concat('flag:', l_returnflag), concat('status:', l_linestatus) FROM {lineitem}""",
    "lineage": """SELECT DISTINCT concat('supplier:', l_suppkey) AS src, concat('part:', l_partkey) AS dst FROM {lineitem}
      UNION ALL SELECT concat('part:', p_partkey), concat('brand:', p_brand) FROM {part}""",
    "members": """SELECT concat('user:', c_custkey) AS src, concat('segment:', c_mktsegment) AS dst FROM {customer}
      UNION ALL SELECT concat('user:', c_custkey), concat('nations:', c_nationkey) FROM {customer}
      UNION ALL SELECT concat('nations:', n_nationkey), concat('regions:', n_regionkey) FROM {nation}
      UNION ALL SELECT concat('regions:', r_regionkey), 'everyone' FROM {region}""",
    "perms": """SELECT concat('user:', user_id) AS user_id, concat('nation:', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 25) AS asset_id,
      event_type AS privilege, CASE WHEN event_type = 'error' OR value < 5 THEN 'deny' ELSE 'allow' END AS mode, event_id AS seq FROM {events}""",
    "tags": """SELECT 'tag1' AS tag, true AS pass_through_hierarchy, false AS pass_through_lineage UNION ALL SELECT 'tag2', false, true
      UNION ALL SELECT 'tag3', true, true UNION ALL SELECT 'tag4', false, false""",
    "applied": """SELECT concat('tag', t) AS tag, concat('region:', r_regionkey) AS asset FROM {region} JOIN (SELECT 1 AS t UNION ALL SELECT 3) x ON (r_regionkey + t) % 2 = 0
      UNION ALL SELECT concat('tag', t), concat('nation:', n_nationkey) FROM {nation} JOIN (SELECT 1 AS t UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x ON n_nationkey % 7 = t""",
    "removed": "SELECT concat('tag', t) AS tag, concat('nation:', n_nationkey) AS asset FROM {nation} JOIN (SELECT 1 AS t UNION ALL SELECT 2) x ON n_nationkey % 5 = t",
    "shallow": "SELECT * FROM {hier} WHERE dst LIKE 'region:%' OR dst LIKE 'nation:%' OR dst LIKE 'supplier:%'",
    "flow": "SELECT concat('nation:', n_nationkey) AS src, concat('nation:', n_nationkey + 5) AS dst FROM {nation} WHERE n_nationkey < 20",
    "grants": """SELECT DISTINCT concat('SUPPLIER_', l_suppkey) AS role, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'TABLE' WHEN p_type LIKE 'SMALL%' THEN 'STAGE' ELSE 'VIEW' END AS kind,
      concat_ws('.', 'DB', p_type, p_brand) AS asset, CASE l_returnflag WHEN 'A' THEN 'REFERENCE USAGE' WHEN 'N' THEN 'SELECT' ELSE 'INSERT' END AS privilege
      FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "policies": """SELECT concat('customer:', o_custkey) AS asset, 'user' AS agent_type, concat('user:', l_suppkey) AS agent, l_returnflag AS privilege
      FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey""",
    "config_policy": """SELECT concat('customer:', o_custkey) AS asset, 'user' AS agent_type, concat('user:', l_suppkey) AS agent, l_returnflag AS privilege, l_linestatus AS status
      FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'""",
    "env_policy": """SELECT concat('customer:', o_custkey) AS asset, 'user' AS agent_type, concat('user:', l_suppkey) AS agent, l_returnflag AS privilege, l_linestatus AS status
      FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'""",
    "default_rows": """SELECT concat('region:', r_regionkey) AS root, 1 AS root_depth, '/*' AS path, 'nation' AS target_type, 'group:all' AS agent, 'USAGE' AS privilege FROM {region}
      UNION ALL SELECT concat('region:', r_regionkey), 1, '/**', 'supplier', 'group:all', 'READ' FROM {region}
      UNION ALL SELECT concat('region:', r_regionkey), 1, '/*/*', 'supplier', 'group:all', 'WRITE' FROM {region} WHERE r_regionkey < 3
      UNION ALL SELECT concat('nation:', n_nationkey), 2, '/*', 'supplier', 'group:all', 'OWN' FROM {nation} WHERE n_nationkey % 4 = 0
      UNION ALL SELECT concat('nation:', n_nationkey), 2, '/**', 'supplier', 'group:all', 'MONITOR' FROM {nation} WHERE n_nationkey % 2 = 0""",
    "explicit_rows": "SELECT concat('supplier:', s_suppkey) AS asset, 'group' AS agent_type, 'group:all' AS agent, CASE WHEN s_suppkey % 3 = 0 THEN 'OWN' WHEN s_suppkey % 3 = 1 THEN 'READ' END AS privilege, CASE WHEN s_acctbal > 6000 THEN s_name END AS note FROM {supplier} WHERE s_acctbal > 1000",
}


def needs(text: str) -> list[str]:
    """Derived tables that a text uses, directly or not, each after those it uses itself."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", text):
        if name in DERIVED:
            out += [n for n in [*needs(DERIVED[name]), name] if n not in out]
    return out


def oracle(text: str) -> str:
    """A query on derived tables as one DuckDB statement. Texts that start with WITH bring further table expressions of their own."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', DERIVED[n])})" for n in needs(text)]
    body = re.sub(r"\{(\w+)\}", r"\1", text).strip()
    if body.startswith("WITH RECURSIVE "):
        parts.append(body.removeprefix("WITH RECURSIVE ").strip())
    elif body.startswith("WITH "):
        parts.append(body.removeprefix("WITH ").strip())
    else:
        return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
    return "WITH RECURSIVE " + ", ".join(parts)


class Tables:
    """The driver's tables and the derived ones as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in DERIVED:
                self._known[name] = self.sql(DERIVED[name])
            elif name in RAW:
                self._known[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})

