"""URL filters by a path-template tree, in DataFrame functions alone.

Rules label the urls they fit. All urls then form one tree of path templates per host: segments that vary by
their looks (numbers, long hexadecimal names, digits before a file ending) become wildcards at once, then, level
by level, the children of a node with more than ``FANOUT`` of them do too. Sibling branches whose share of
blocked urls doesn't differ from their pool's (a chi-squared test with one degree of freedom) are merged. A
template's purity is its blocked share among labelled urls, smoothed towards the same template's share over all
hosts, which is itself smoothed towards the overall share; purity above ``CUT`` rejects a template.
A url that a rule fits takes the rule's verdict, every other url its template's.

Every level is tried at which some host has enough urls for a node with more than ``FANOUT`` children. Every row keeps a verdict. A null url, or one without
"://", has an empty host and path, no rule, and the verdict of the empty template. Repeated rows and null ids
are kept row by row, extra columns are ignored, and an empty table gives an empty table. Hot hosts: rows are
aggregated to templates before any shuffle on the host, and only small aggregates join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# The production rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
FANOUT, ALPHA, CUT, CHI2 = 32, 5.0, 0.8, 3.84
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NUMBER, HEX, ENDING = r"^[0-9]+$", r"^[0-9a-fA-F]{8,}$", r"^.*[0-9].*(\.[a-z]{1,5})$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; of equally long ones the first listed."""
    fits = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(fit, value) if fits is None else fits.when(fit, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segment_looks(s: Column) -> Column:
    return F.when(s.rlike(NUMBER) | s.rlike(HEX), F.lit("*")).when(s.rlike(ENDING), F.concat(F.lit("*"), F.regexp_extract(s, ENDING, 1))).otherwise(s)


def looks_of(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), segment_looks), "/")


def levels(tree: DataFrame, fanout: int) -> int:
    """The last level at which a node can have more than ``fanout`` children: so many urls of a host go deeper."""
    sizes = tree.groupBy("host", F.size("segments").alias("size")).agg(F.count("*").alias("n"))
    longer = sizes.withColumn("n", F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size"))))
    return (longer.where(F.col("n") > fanout).agg(F.max("size")).first()[0] or 1) - 1


def templates(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves (host, looks, n, labelled, blocked) with their final ``template``."""
    tree = materialize(leaves.withColumn("segments", F.split("looks", "/")))
    for level in range(1, levels(tree, fanout) + 1):
        parent = F.array_join(F.slice("segments", 1, level), "/")
        child = F.get("segments", F.lit(level))
        own = tree.withColumn("parent", parent).withColumn("child", child)
        wide = own.where("child is not null").groupBy("host", "parent", "child").agg(F.lit(1).alias("one")).groupBy("host", "parent").agg(F.count("*").alias("children")).where(F.col("children") > fanout)
        cut = F.concat(F.slice("segments", 1, level), F.array(F.lit("*")), F.slice("segments", level + 2, F.greatest(F.size("segments") - level - 1, F.lit(0))))
        tree = materialize(
            own.join(wide, ["host", "parent"], "left")
            .withColumn("segments", F.when(F.col("children").isNotNull() & F.col("child").isNotNull(), cut).otherwise(F.col("segments")))
            .drop("parent", "child", "children")
        )
    return tree.withColumn("template", F.array_join("segments", "/")).drop("segments")


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity): smoothed labelled purity after merging similar siblings."""
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    branch = tree.groupBy("host", "template").agg(*sums).withColumn("parent", F.regexp_replace("template", r"[^/]*/?$", ""))
    pool = branch.groupBy("host", "parent").agg(F.sum("labelled").alias("pool_l"), F.sum("blocked").alias("pool_b"))
    every = tree.groupBy("template").agg(F.sum("labelled").alias("all_l"), F.sum("blocked").alias("all_b"))
    total = tree.agg((F.coalesce(F.try_divide(F.sum("blocked"), F.sum("labelled")), F.lit(0.5))).alias("rate"))
    x = branch.join(pool, ["host", "parent"]).join(every, "template").join(F.broadcast(total))  # one row
    share = F.try_divide("pool_b", "pool_l")
    apart = (F.col("labelled") > 0) & (
        F.pow(F.try_divide("blocked", "labelled") - share, F.lit(2.0)) * F.col("labelled") > CHI2 * share * (1 - share)
    )
    prior = (F.col("all_b") + ALPHA * F.col("rate")) / (F.col("all_l") + ALPHA)
    own = lambda mine, pooled: F.when(apart, F.col(mine)).otherwise(F.col(pooled))
    purity = (own("blocked", "pool_b") + ALPHA * prior) / (own("labelled", "pool_l") + ALPHA)
    return x.select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, cut: float = CUT, fanout: int = FANOUT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    u = F.col(url)
    p = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    p = p.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("looks", looks_of(F.col("path")))
    leaves = p.groupBy("host", "looks").agg(
        F.count("*").alias("n"), F.count("r").alias("labelled"), F.count(F.when(F.col("r.verdict") == "block", 1)).alias("blocked")
    )
    tree = templates(leaves, fanout)
    verdicts = tree.join(purities(tree), ["host", "template"]).select("host", "looks", "template", "purity")
    return p.join(verdicts, ["host", "looks"], "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("purity") > cut, "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )


def sql(table: str = "pages", rules=RULES) -> str:
    """The same in DuckDB's SQL, for the production parameters."""
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{value(v, h, p)}'" for v, h, p in longest) + " END"
    parts = [f"""WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url FROM {table}),
h AS (SELECT page_id, translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{URL}', 2) AS path FROM u),
p AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled,
  array_to_string(list_transform(string_split(path, '/'), lambda s: CASE WHEN regexp_matches(s, '{NUMBER}') OR regexp_matches(s, '{HEX}') THEN '*'
    WHEN regexp_matches(s, '{ENDING}') THEN '*' || regexp_extract(s, '{ENDING}', 1) ELSE s END), '/') AS looks FROM h),
t0 AS (SELECT host, looks, count(rule) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, string_split(looks, '/') AS segments FROM p GROUP BY host, looks)"""]
    parts.append(f"""deep AS (SELECT max(len(segments)) AS deepest FROM t0),
tree AS (SELECT 1 AS level, host, looks, labelled, blocked, segments FROM t0 UNION ALL
  SELECT level + 1, host, looks, labelled, blocked, CASE WHEN child IS NOT NULL AND children > {FANOUT} THEN list_concat(list_concat(segments[1:level], ['*']), segments[level + 2:]) ELSE segments END
  FROM (SELECT *, segments[level + 1] AS child, count(DISTINCT segments[level + 1]) OVER (PARTITION BY host, array_to_string(segments[1:level], '/')) AS children FROM tree) x JOIN deep ON level < deepest),
t AS (SELECT host, looks, labelled, blocked, array_to_string(segments, '/') AS template FROM tree JOIN deep ON level = deepest),
b AS (SELECT host, template, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked, regexp_replace(template, '[^/]*/?$', '') AS parent FROM t GROUP BY host, template),
pool AS (SELECT host, parent, sum(labelled)::BIGINT AS pool_l, sum(blocked)::BIGINT AS pool_b FROM b GROUP BY host, parent),
ev AS (SELECT template, sum(labelled)::BIGINT AS all_l, sum(blocked)::BIGINT AS all_b FROM t GROUP BY template),
tot AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked)::DOUBLE / sum(labelled)::DOUBLE ELSE 0.5 END AS rate FROM t),
x AS (SELECT *, (all_b + {ALPHA}::DOUBLE * rate) / (all_l + {ALPHA}::DOUBLE) AS prior, pool_b::DOUBLE / nullif(pool_l, 0) AS share
  FROM b JOIN pool USING (host, parent) JOIN ev USING (template) CROSS JOIN tot),
y AS (SELECT *, coalesce(labelled > 0 AND pow(blocked::DOUBLE / nullif(labelled, 0) - share, 2.0) * labelled > {CHI2}::DOUBLE * share * (1 - share), false) AS apart FROM x),
z AS (SELECT host, template, (CASE WHEN apart THEN blocked ELSE pool_b END + {ALPHA}::DOUBLE * prior) / (CASE WHEN apart THEN labelled ELSE pool_l END + {ALPHA}::DOUBLE) AS purity FROM y)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.ruled, CASE WHEN z.purity > {CUT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN t ON p.host = t.host AND p.looks = t.looks LEFT JOIN z ON t.host = z.host AND t.template = z.template""")
    return ",\n".join(parts)
