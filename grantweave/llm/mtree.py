"""Exact top-k search by inner product with M-trees.

Components become floor(256 * x). With one more component that gives all vectors the same norm M, a larger inner
product is a smaller Euclidean distance, d^2 = |q|^2 + M^2 - 2 q.x, so metric trees apply; scores stay integers.

Equal vectors are stored once with their k + 1 least ids, which is all that any query can return of them. Vectors go to
the nearest of at most ``PIVOTS`` pivots (those with the least hashes; the choice affects speed alone), and a pivot's vectors
are dealt to shards of about ``SHARD``. A shard is an M-tree stored as pages of at most ``PAGE`` entries: each with its
vector, covering radius, distance to the page's own centre, and child page. Queries are searched in blocks of about
``BLOCK`` neighbours (queries of one pivot lie together), so neither queries nor vectors must fit in one task. A block takes
its queries to their own pivot's shards first, and then, with the k-th scores found there, to the shards of pivots whose
covering radius leaves room for a better one; only pages that some block asks for are copied to it. Within a shard pages are
visited best first; entries whose stored distances already exclude them for all queries of a page are never computed, and
what remains is one matrix product a page.

Every row but the query's own is a candidate, repeated rows as often as they occur; a repeated query row gives its result
as often. Rows without id are candidates (after all ids at equal scores) but no queries. Null vectors and those with null or
non-finite components take no part; empty vectors do, with score 0. Vectors are compared with those of equal length. Extra
columns are ignored. An empty table gives an empty result. Vectors whose scaled squared norm reaches 2^52 stay out of the trees; pairs with
one of them are scored as whole numbers, block by block (``long_vectors``). A score beyond a long stands at its bound, but ranks follow
the exact scores. An id of 2^63 - 1 reads as null.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_groups
from .jaccard import groups_in
from .long_vectors import key_column, scored

SCALE, K, EVERY, PIVOTS, SHARD, PAGE, BLOCK = 256, 5, 50, 256, 8192, 64, 4096
NO_ID, LOW = (1 << 63) - 1, -(1 << 62)
LONG = float(1 << 52)


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x, long): rows that take part, and whether their vector is too long for the trees."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, c: a + F.pow(F.least(F.abs(c), F.lit(1e9)) * SCALE + 1, F.lit(2.0)))  # no less than that of floor(256 x)
    return rows.where(F.col("x").isNotNull() & F.forall("x", fine)).withColumn("long", norm2 >= LONG)


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, v): whole components of the rows that aren't too long."""
    return rows.where(~F.col("long")).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def least_ids(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """Each vector once, with the k + 1 least ids of its rows."""
    ids = rows.select(vector, F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy(vector).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy(vector).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def same_norm(v: np.ndarray, m2: float) -> np.ndarray:
    v = v.astype(float)
    return np.hstack([v, np.sqrt(np.maximum(m2 - (v * v).sum(axis=1), 0))[:, None]])


def stacked(vectors, dim: int) -> np.ndarray:
    return np.array(list(vectors), np.int64).reshape(len(vectors), dim)


def homes(vectors: pd.Series, pivots: dict[int, np.ndarray], m2: float, query: bool) -> np.ndarray:
    """The nearest pivot of each vector, as a point of norm M or as a query; 0 where no pivot has its length."""
    out, dims = np.zeros(len(vectors), np.int32), np.array([len(v) for v in vectors], np.int64)
    for dim in np.unique(dims).tolist():
        if dim in pivots:
            at = np.flatnonzero(dims == dim)
            v = stacked(vectors.iloc[at], dim)
            near = -(v.astype(float) @ pivots[dim].T.astype(float)) if query else distances(same_norm(v, m2), same_norm(pivots[dim], m2))
            out[at] = near.argmin(axis=1)
    return out


def build(v: np.ndarray, m2: float) -> list[dict]:
    """The pages of one shard's tree; page 0 is the root, entries are places in ``v``."""
    points = same_norm(v, m2)
    pages: list[dict] = []

    def add(members: np.ndarray, centre: np.ndarray) -> int:
        number = len(pages)
        pages.append({})
        if len(members) <= PAGE:
            pages[number] = {"leaf": True, "entry": members, "apart": distances(points[members], centre[None, :])[:, 0], "radius": np.zeros(len(members)), "child": np.full(len(members), -1, np.int32)}
            return number
        fan = min(PAGE, -(-len(members) // PAGE))
        routing = members[np.linspace(0, len(members) - 1, max(2, fan)).astype(int)]
        d = distances(points[members], points[routing])
        nearest = d.argmin(axis=1)
        groups = [np.flatnonzero(nearest == g) for g in range(len(routing))]
        if max(map(len, groups)) > 0.9 * len(members):  # vectors too alike to part by the nearest: part by distance instead
            groups = np.array_split(np.argsort(d[:, 0], kind="stable"), len(routing))
        kept = [(r, members[g], float(d[g, i].max())) for i, (r, g) in enumerate(zip(routing, groups, strict=True)) if len(g)]
        entry = np.array([r for r, _, _ in kept])
        child = [add(g, points[r]) for r, g, _ in kept]
        pages[number] = {"leaf": False, "entry": entry, "apart": distances(points[entry], centre[None, :])[:, 0], "radius": np.array([x for _, _, x in kept]), "child": np.array(child, np.int32)}
        return number

    add(np.arange(len(v)), points[0])
    return pages


class Queries:
    """A block of queries with the best found so far: ids, vectors, squared norms, floors (k-th scores known already)."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, m2: float):
        self.ids, self.q, self.k = ids, q.astype(float), k
        self.norm2 = (self.q * self.q).sum(axis=1)
        self.total = self.norm2 + m2
        self.slack = 0.01 + 1e-9 * self.total
        self.score, self.id = np.full((len(ids), k), LOW, np.int64), np.full((len(ids), k), NO_ID, np.int64)
        self.floor = floor
        self.found = np.zeros(len(ids), np.int64)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        """Scores below these can't enter any more."""
        return np.maximum(self.floor[rows], self.score[rows, -1])

    def bound(self, rows: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The largest score of anything at least ``near`` away (a row per query)."""
        return np.floor((self.total[rows][:, None] - np.maximum(near, 0) ** 2) / 2 + self.slack[rows][:, None])

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the given rows: scores by row and candidate (LOW: none), and the candidates' ids."""
        better = (score >= self.worst(rows)[:, None]) & (score > LOW)
        some = better.any(axis=1)
        rows, score, better = rows[some], score[some], better[some]
        if not len(rows):
            return
        used = better.any(axis=0)
        every = np.hstack([self.score[rows], np.where(better, score, LOW)[:, used]])
        names = np.hstack([self.id[rows], np.broadcast_to(ids[used], (len(rows), int(used.sum())))])
        order = np.lexsort((names, -every), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)


class Tree:
    """A shard's pages, read back, with search."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("page")
        dim = int(frame["dim"].iat[0])
        self.pages = []
        for p in frame.itertuples():
            apart = np.frombuffer(p.apart)
            v = np.frombuffer(p.vectors, np.int64).reshape(len(apart), dim).astype(float)
            slot = np.repeat(np.arange(len(apart)), np.frombuffer(p.slots, np.int32)) if p.leaf else None
            self.pages.append((p.leaf, v, apart, np.frombuffer(p.radius), np.frombuffer(p.child, np.int32), slot, np.frombuffer(p.ids, np.int64)))
        self.centre = np.frombuffer(frame["centre"].iat[0], np.int64).astype(float)

    def search(self, x: Queries, rows: np.ndarray) -> None:
        """Offer to the queries at ``rows`` what this shard holds for them."""
        away = np.sqrt(np.maximum(x.total[rows] - 2 * (x.q[rows] @ self.centre), 0))
        number = count()
        todo = [(-np.inf, next(number), 0, rows, np.full(len(rows), np.inf), away)]
        while todo:
            _, _, page, rows, upper, away = heapq.heappop(todo)
            live = upper >= x.worst(rows)
            rows, away = rows[live], away[live]
            leaf, v, apart, radius, child, slot, ids = self.pages[page]
            # what the stored distances to the centre and the radii leave possible
            possible = x.bound(rows, np.abs(away[:, None] - apart[None, :]) - radius[None, :]) >= x.worst(rows)[:, None]
            live, use = possible.any(axis=1), np.flatnonzero(possible.any(axis=0))
            if not len(use):
                continue
            rows, possible = rows[live], possible[live][:, use]
            score = x.q[rows] @ v[use].T
            if leaf:
                place = np.searchsorted(use, slot)
                mine = (place < len(use)) & (use[np.minimum(place, len(use) - 1)] == slot)
                place, names = place[mine], ids[mine]
                # the query's own row: its id under an equal vector, and of several such rows one
                first = np.concatenate([[True], (names[1:] != names[:-1]) | (place[1:] != place[:-1])]) if len(names) else np.zeros(0, bool)
                norm2 = (v[use] * v[use]).sum(axis=1)
                equal = (score == x.norm2[rows][:, None]) & (norm2[None, :] == x.norm2[rows][:, None])
                own = equal[:, place] & first[None, :] & (names[None, :] == x.ids[rows][:, None])
                x.offer(rows, np.where(own, LOW, score[:, place].astype(np.int64)), names)
                continue
            d = np.sqrt(np.maximum(x.total[rows][:, None] - 2.0 * score, 0))
            upper = x.bound(rows, d - radius[use][None, :])
            live = possible & (upper >= x.worst(rows)[:, None])
            for i in np.flatnonzero(live.any(axis=0)).tolist():
                on = live[:, i]
                heapq.heappush(todo, (-float(upper[on, i].max()), next(number), int(child[use[i]]), rows[on], upper[on, i], d[on, i]))


SHARD_KEY = ["dim", "pivot", "chunk"]
PAGES = "dim int, pivot int, chunk int, page int, leaf boolean, vectors binary, apart binary, radius binary, child binary, ids binary, slots binary, centre binary, reach double"


def index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> tuple[DataFrame, DataFrame, float, dict]:
    """(pages, all usable rows, M^2, pivots by length)."""
    every = usable(df, vec_id, vector)
    x = integers(every)
    once = least_ids(x, "v", k)
    once = materialize(once.withColumn("dim", F.size("v")).withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)))
    n, m2 = once.agg(F.count("*"), F.max("norm2")).first()
    m2 = float(m2 or 0)
    rows = once.orderBy(F.xxhash64("v"), "v").select("v").limit(min(PIVOTS, max(1, n // SHARD + 1))).collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r.v), []).append(r.v)
    pivots = {d: stacked(v, d) for d, v in found.items()}

    def nearest(batches):
        for b in batches:
            yield b.assign(pivot=homes(b["v"], pivots, m2, False))

    placed = materialize(once.drop("norm2").mapInPandas(nearest, "v array<long>, ids array<long>, dim int, pivot int"))
    chunks = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("chunks"))
    dealt = placed.join(chunks, ["dim", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *SHARD_KEY).sortWithinPartitions(*SHARD_KEY, "v")

    def trees(batches):
        for frame in whole_groups(batches, SHARD_KEY):
            for a, z in groups_in(frame, SHARD_KEY):
                part = frame.iloc[a:z]
                dim, pivot, chunk = (int(part[c].iat[0]) for c in SHARD_KEY)
                v, held = stacked(part["v"], dim), [np.asarray(i, np.int64) for i in part["ids"]]
                own = pivots[dim][pivot] if dim in pivots else v[0]
                reach = float(distances(same_norm(v, m2), same_norm(own[None, :], m2)).max())
                out = []
                for i, p in enumerate(build(v, m2)):
                    mine = [held[e] for e in p["entry"]] if p["leaf"] else []
                    out.append((dim, pivot, chunk, i, p["leaf"], v[p["entry"]].tobytes(), p["apart"].tobytes(), p["radius"].tobytes(), p["child"].tobytes(), b"".join(x.tobytes() for x in mine), np.array([len(x) for x in mine], np.int32).tobytes(), v[0].tobytes(), reach))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGES.split(", ")])

    return materialize(dealt.mapInPandas(trees, PAGES)), every, m2, pivots


def top_k(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by ``every``."""
    pages, rows, m2, pivots = index(df, vec_id, vector, k)
    asked = integers(rows).where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).agg(F.count("*").alias("times"))

    def at_home(batches):
        for b in batches:
            yield b.assign(home=homes(b["q"], pivots, m2, True))

    asked = asked.withColumn("dim", F.size("q")).withColumn("qk", F.monotonically_increasing_id())
    asked = materialize(asked.mapInPandas(at_home, "query_id long, q array<long>, times long, dim int, qk long, home int"))
    # neighbouring pivots share a block until it is full; a pivot with many queries fills several
    sizes = asked.groupBy("dim", "home").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("dim").orderBy("home")) - F.col("n"))  # a row per pivot
    queries = asked.join(sizes, ["dim", "home"]).withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("qk"), "n")) / BLOCK).cast("int"))
    queries = materialize(queries.select("qk", "query_id", "q", "times", "dim", "home", "block"))
    shards = materialize(pages.groupBy(*SHARD_KEY).agg(F.max("reach").alias("reach")))
    reach: dict[int, dict[int, float]] = {}
    for r in shards.groupBy("dim", "pivot").agg(F.max("reach").alias("reach")).collect():  # a row per pivot
        reach.setdefault(r.dim, {})[r.pivot] = r.reach

    def upper(dim: int, pivot: int, q: np.ndarray) -> np.ndarray:
        """The largest score that each query can find among the vectors of a pivot."""
        v = q.astype(float)
        total = (v * v).sum(axis=1) + m2
        away = np.sqrt(np.maximum(total - 2 * (v @ pivots[dim][pivot].astype(float)), 0))
        return (total - np.maximum(away - reach[dim][pivot], 0) ** 2) / 2 + 0.01 + 1e-9 * total

    def rooms(batches):
        """(dim, block, pivot): pivots, other than their own, that can hold something for a query of the block."""
        for b in batches:
            seen = set()
            for (dim, block), part in b.groupby(["dim", "block"]):
                if dim in pivots:
                    q, floor, home = stacked(part["q"], dim), part["floor"].to_numpy(), part["home"].to_numpy()
                    seen |= {(dim, block, p) for p in reach.get(dim, {}) if ((home != p) & (upper(dim, p, q) >= floor)).any()}
            yield pd.DataFrame(sorted(seen), columns=["dim", "block", "pivot"])

    def searched(todo: DataFrame, tasks: DataFrame, first: bool) -> DataFrame:
        key = [*SHARD_KEY, "block"]
        tasks = materialize(tasks.join(shards.select(*SHARD_KEY), ["dim", "pivot"]).select(*key))

        def answer(mine: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"qk": [], "query_id": [], "vec_id": [], "score": [], "times": []}, dtype="int64")
            if not len(mine) or not len(held):
                return none
            dim, pivot = int(held["dim"].iat[0]), int(held["pivot"].iat[0])
            mine = mine[(mine["home"] == pivot) == first]
            if not len(mine):
                return none
            block = Queries(mine["query_id"].to_numpy(), stacked(mine["q"], dim), mine["floor"].to_numpy(), k, m2)
            rows = np.arange(len(mine))
            if not first:
                rows = rows[upper(dim, pivot, block.q) >= block.floor]
            Tree(held).search(block, rows)
            at, place = np.nonzero(block.score > LOW)
            return pd.DataFrame({"qk": mine["qk"].to_numpy()[at], "query_id": block.ids[at], "vec_id": block.id[at, place], "score": block.score[at, place], "times": mine["times"].to_numpy()[at]})

        asks, copies = todo.join(tasks, ["dim", "block"]), pages.join(tasks, SHARD_KEY)
        return asks.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(answer, "qk long, query_id long, vec_id long, score long, times long")

    best = Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    near = materialize(searched(queries.withColumn("floor", F.lit(LOW)), queries.select("dim", "block", F.col("home").alias("pivot")).distinct(), True))
    floors = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("qk", F.col("score").alias("floor"))
    todo = materialize(queries.join(floors, "qk", "left").withColumn("floor", F.coalesce("floor", F.lit(LOW))))
    rest = searched(todo, todo.select("dim", "block", "home", "q", "floor").mapInPandas(rooms, "dim int, block int, pivot int").distinct(), False)
    both = near.unionByName(rest)
    if rows.where("long").limit(1).count():
        both, best = both.withColumn("key", key_column(F.col("score"))).unionByName(with_long(rows, queries, every, k)), Window.partitionBy("qk").orderBy(F.desc("key"), "vec_id")
    found = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")


def with_long(rows: DataFrame, queries: DataFrame, every: int, k: int) -> DataFrame:
    """What queries find where they or the vectors found are too long for the trees."""
    usual = queries.select("qk", "query_id", F.transform("q", lambda c: c / SCALE).alias("x"), "times", F.lit(False).alias("long"))
    own = rows.where(F.col("long") & (F.col("vec_id") % every == 0)).groupBy(F.col("vec_id").alias("query_id"), "x").agg(F.count("*").alias("times"))
    own = own.select((-1 - F.monotonically_increasing_id()).alias("qk"), "query_id", "x", "times", F.lit(True).alias("long"))
    vectors = [least_ids(rows.where(F.col("long") == flag), "x", k).withColumn("long", F.lit(flag)) for flag in (True, False)]
    return scored(materialize(usual.unionByName(own)), materialize(vectors[0].unionByName(vectors[1])), k)


def sql(table: str = "embeddings") -> str:
    return f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS v FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END::BIGINT AS score
  FROM x q JOIN x c ON c.rid <> q.rid AND len(c.v) = len(q.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
