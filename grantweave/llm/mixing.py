"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic (``topics``); a document weighs its tokens, as the token count
operator gives them. The sample is to hold ``FRACTION`` of all tokens, divided by the target marginals of the three. Cells' expected
tokens in the sample are raked in turn to the marginals, no cell giving more than it has: a cell is kept at most whole, and the
others of its marginal make up for it. Rounds go on until every marginal is met within ``TOLERANCE``, or until the largest
deviation has stopped falling (targets that contradict each other, or ask for more than there is); ``marginals`` reports target and
outcome of each key, and a warning tells the largest deviation. A cell's documents are sampled with the probability
expected / present tokens. The draw is a hash of id and text, so reruns and copies agree.

Targets are tables (key, share); by default each marginal's present shares to the power ``ALPHA``,
which lifts small sources, languages and topics, but no key to more than all of it. A key missing from a target, or with share 0, gets
no weight.

Nulls in source or lang form a cell value of their own. A null or empty text has no tokens and topic -1; a cell
without tokens keeps probability 0, for nothing in it has weight. Repeated rows are drawn together.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokens import count_tokens
from .topics import vectors, with_topics

ALPHA, TOLERANCE, STALL, FRACTION, SEED = 0.5, 1e-3, 0.8, 0.5, 20260
DIMENSIONS = ("source", "lang", "topic")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` and the topic vector ``v``."""
    small_batches(docs.sparkSession)
    return count_tokens(docs, text, "tokens").withColumn("v", vectors(F.col(text)))


def described(stored: DataFrame) -> DataFrame:
    """Stored rows with features, their topic in place of the vector, and a struct ``w`` of tokens and topic."""
    return with_topics(stored).withColumn("w", F.struct("tokens", "topic")).drop("tokens", "topic")


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``w`` of its tokens and topic."""
    return described(materialize(features(docs, text)))


def cells_of(described: DataFrame) -> DataFrame:
    return described.groupBy("source", "lang", F.col("w.topic").alias("topic")).agg(F.sum("w.tokens").cast("double").alias("mass"), F.count("*").alias("docs")).where("mass > 0")


def filled(keys: DataFrame, budget: float) -> float:
    """The scale at which min(mass, scale * want) adds up to the budget; a few sums over the keys."""
    scale, whole = 0.0, -1
    while True:
        full = F.col("want") * scale >= F.col("mass")
        n, taken, rest = keys.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("mass"))), F.sum(F.when(~full, F.col("want")))).first()
        if n <= whole or not rest:
            return scale
        scale, whole = max(scale, (budget - (taken or 0.0)) / rest), n


def tempered(cells: DataFrame, key: str, alpha: float = ALPHA, fraction: float = FRACTION) -> DataFrame:
    """(key, share): the present shares to the power alpha, as far as a sample of the fraction can have them."""
    keys = materialize(cells.groupBy(F.col(key).alias("key")).agg(F.sum("mass").alias("mass")).withColumn("want", F.pow("mass", F.lit(alpha))))
    budget = fraction * (keys.agg(F.sum("mass")).first()[0] or 0.0)
    scale = filled(keys, budget)
    return keys.select("key", (F.least("mass", F.col("want") * scale) / budget).alias("share"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int | None = None, tolerance: float = TOLERANCE, fraction: float = FRACTION) -> DataFrame:
    """The cells with ``weight`` (their expected share of the sample), ``p``, and the targets of their marginals.

    ``z`` is what a cell would give if it had enough; min(z, mass) is what it gives. Each marginal is one small job whose result is stored,
    so plans stay short. ``rounds`` limits them; by default the deviation decides alone.
    """
    cells = materialize(cells)
    budget = fraction * (cells.agg(F.sum("mass")).first()[0] or 0.0)
    fitted = cells.withColumn("z", F.col("mass") * fraction)
    for d in DIMENSIONS:
        goal = (targets or {}).get(d) or tempered(cells, d, fraction=fraction)
        goal = goal.select(F.col("key").alias("g"), (F.col("share") * budget).alias(f"goal_{d}"))
        fitted = fitted.join(goal, same(F.col(d), F.col("g")), "left").drop("g").fillna({f"goal_{d}": 0.0})
    fitted = materialize(fitted.withColumn("off", F.lit(0.0)))
    gives, short = F.least("z", "mass"), F.col("z") < F.col("mass")
    seen, worst = [], float("inf")
    while budget and (rounds is None or len(seen) < rounds):
        for d in DIMENSIONS:
            t = F.col("t")
            now = fitted.groupBy(F.col(d).alias("k")).agg(
                F.max(f"goal_{d}").alias("t"), F.sum(gives).alias("given"), F.sum(F.when(short, 0.0).otherwise(F.col("mass"))).alias("whole"), F.sum(F.when(short, F.col("z")).otherwise(0.0)).alias("free")
            )
            # cells that give all they have can't give more: the others make up for it
            more = F.when((F.col("free") > 0) & (t > F.col("whole")), (t - F.col("whole")) / F.col("free"))
            factor = now.select("k", F.coalesce(more, F.try_divide("t", "given"), F.lit(0.0)).alias("f"), F.abs(F.coalesce(F.try_divide("given", "t"), F.lit(1.0)) - 1).alias("o"))
            before = F.lit(0.0) if d == DIMENSIONS[0] else F.col("off")
            fitted = materialize(fitted.join(factor, same(F.col(d), F.col("k"))).withColumns({"z": F.col("z") * F.col("f"), "off": F.greatest(before, "o")}).drop("k", "f", "o"))
        worst = fitted.agg(F.max("off")).first()[0] or 0.0
        seen.append(worst)
        if worst <= tolerance or len(seen) > 5 and worst > STALL * seen[-6]:
            break
    if budget and worst > tolerance:
        warnings.warn(f"marginals are met within {worst:.2%} only", stacklevel=2)
    return fitted.withColumns({"weight": gives / budget if budget else F.lit(0.0), "p": gives / F.col("mass")}).drop("z", "off")


def marginals(fitted: DataFrame) -> DataFrame:
    """(dimension, key, target, reached): tokens that the sample is to hold and is expected to hold, for each key of each marginal."""
    one = lambda d: fitted.groupBy(F.col(d).cast("string").alias("key")).agg(F.max(f"goal_{d}").alias("target"), F.sum(F.col("p") * F.col("mass")).alias("reached")).select(F.lit(d).alias("dimension"), "key", "target", "reached")
    first, *others = map(one, DIMENSIONS)
    for x in others:
        first = first.union(x)
    return first


def draw(*columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11) / F.lit(float(1 << 53))


def with_probability(described: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``described`` (stored: it is read twice) with p and selected."""
    fitted = materialize(rake(cells_of(described), targets).select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("topic").alias("t"), "p"))
    on = same(F.col("source"), F.col("s")) & same(F.col("lang"), F.col("l")) & same(F.col("w.topic"), F.col("t"))
    return described.join(fitted, on, "left").drop("s", "l", "t").withColumn("p", F.coalesce("p", F.lit(0.0))).withColumn("selected", F.col("u") < F.col("p"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per document: its cell, tokens, probability, and whether it is in the sample."""
    docs = docs.select("doc_id", "source", "lang", "text", draw(F.col("doc_id"), F.col("text")).alias("u"))
    x = with_probability(described(materialize(features(docs).drop("text"))), targets)
    return x.select("doc_id", "source", "lang", F.col("w.topic").alias("topic"), F.col("w.tokens").alias("tokens"), "p", "selected")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled documents, with their own columns and the probability they were drawn with."""
    carried = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "sampling_p"]).alias("row"), F.col("source").alias("source"), F.col("lang").alias("lang"), F.col("text").alias("judged"), draw(F.col("doc_id"), F.col("text")).alias("u"))
    x = with_probability(described(materialize(features(carried, "judged").drop("judged"))), targets)
    return x.where("selected").select("row.*", F.col("p").alias("sampling_p"))
