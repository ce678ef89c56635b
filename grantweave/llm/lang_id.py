"""Language identification by fusing Bayesian evidence.

A text's likelihood under each language comes from byte trigrams of its lower-case form. They are counted in Spark over
about ``SAMPLE`` labelled rows of each language (those whose hash of id and text falls under a cut that the language's row
count sets; all rows of a language that has fewer), so that rare ones have their class too; only one vector of bucket
counts a language reaches the driver. More than ``LANGUAGES`` labels are an error. An "und" class with uniform trigrams
stands for everything else. Three further kinds of evidence are
combined with it: the declared markup language, the address suffix (a host's last label), and a prior of the
host. Their tables are grouped aggregates over all rows, counting the languages that texts alone make clear:
P(declared | language) and P(suffix | language) with additive smoothing, and P(language | host) smoothed towards
the host's parent domain, which is smoothed towards all rows. Log evidence is added; a softmax gives the posterior.
Documents have neither markup nor address: their label trains the classifier and is no evidence, their source is a host.

Rows whose text has no trigram get "und" and are rejected, as are rows whose most probable language is "und" or
has a posterior under ``LEAST``. A null text counts as empty; a null declared language, url or host gives no
evidence of its kind; repeated rows and null ids are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

SAMPLE, LANGUAGES, BUCKETS, LEAST, CLEAR, KAPPA, ADD = 2000, 256, 1 << 16, 0.5, 0.99, 20.0, 1.0
UND = "und"
#: Trigrams overlap, so each counts for a third of the evidence.
TEMPER = 1.0 / 3.0


def trigrams(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.uint32)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    letters = (data >= 97) & (data <= 122) | (data >= 128)
    code = code[letters[1:-1] | letters[:-2] | letters[2:]]  # blanks, digits and signs alone tell nothing
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def model_of(counts: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language) from bucket counts by language; the last language is "und"."""
    names = sorted(k for k, v in counts.items() if v.sum() and k != UND)
    table = [np.log((counts[k] + 0.1) / (counts[k].sum() + 0.1 * BUCKETS)) for k in names]
    return [*names, UND], np.stack([*table, np.full(BUCKETS, -np.log(BUCKETS))], axis=1)


def bucket_counts(rows: Iterable[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Trigrams by bucket for each language of (language, text) rows."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        g = trigrams(text)
        if len(g):
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64)).__iadd__(np.bincount(g, minlength=BUCKETS))
    return counts


def train(rows: Iterable[tuple[str, str]]) -> tuple[list[str], np.ndarray]:
    """The model of a few rows at hand."""
    return model_of(bucket_counts(rows))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    # a share of each language's hashes that holds the sample with some room for chance
    sizes = labelled.groupBy("l").agg((F.lit(sample + 8 * sample**0.5 + 16) / F.count("*")).alias("share"))
    shares = sizes.limit(LANGUAGES + 1).collect()
    if len(shares) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different labels in {lang}")
    if not shares:
        return model_of({})
    shares = docs.sparkSession.createDataFrame(shares, "l string, share double")
    chosen = labelled.join(F.broadcast(shares), "l").where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.col("share")).select("l", "t")  # LANGUAGES rows at most

    def count(batches):
        for lg, n in bucket_counts(row for b in batches for row in zip(b["l"], b["t"], strict=True)).items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"l": lg, "bucket": at.astype(np.int32), "n": n[at]})

    def vector(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(BUCKETS, np.int64)
        n[rows["bucket"]] = rows["n"]
        return pd.DataFrame({"l": rows["l"].iloc[:1], "n": [n.tobytes()]})

    counts = chosen.mapInPandas(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("l").applyInPandas(vector, "l string, n binary").collect()  # BUCKETS numbers a language
    return model_of({r.l: np.frombuffer(bytes(r.n), np.int64) for r in rows})


SCORE = T.StructType([T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("best", T.IntegerType()), T.StructField("p", T.DoubleType())])


def score(df: DataFrame, text: Column, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``df`` with ``ll``, the tempered log-likelihoods in the model's order, and ``best`` and ``p``, the place and posterior of the
    language that the text alone makes most probable; null where a text has no trigram."""
    small_batches(df.sparkSession)
    bc = df.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))  # 256 KB a language

    @F.pandas_udf(SCORE)
    def likelihoods(texts: pd.Series) -> pd.DataFrame:
        table, out = bc.value, []
        for t in texts.fillna(""):
            g = trigrams(t)
            counts = np.bincount(g, minlength=1) if len(g) > BUCKETS else None
            total = (counts @ table[: len(counts)].astype(float) if counts is not None else table[g].sum(axis=0, dtype=float)) * TEMPER
            out.append((total.tolist(), int(total.argmax()), float(1 / np.exp(total - total.max()).sum())) if len(g) else (None, None, None))
        return pd.DataFrame(out, columns=["ll", "best", "p"]).astype({"best": "Int32"})

    return df.withColumn("score", likelihoods(text)).select("*", "score.*").drop("score")


def identify(scored: DataFrame, names: list[str]) -> DataFrame:
    """``scored`` (ll, best, p, declared, suffix, host, domain) with lang_id, posterior and accepted. ``scored`` is read several times: it should be stored."""
    n = len(names)
    counted = scored.where((F.col("ll").isNotNull()) & (F.col("p") >= CLEAR))
    counts = F.array(*[F.count(F.when(F.col("best") == i, 1)).cast("double") for i in range(n)]).alias("c")
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = counted.agg(counts).select(F.transform("c", lambda x: (x + ADD) / (size("c") + ADD * n)).alias("p_all"))

    def given_language(key: str) -> DataFrame:
        """log P(key | language) for each key."""
        found = counted.where(F.col(key).isNotNull()).groupBy(key).agg(counts)
        every = found.agg(F.array(*[F.coalesce(F.sum(F.col("c")[i]), F.lit(0.0)) for i in range(n)]).alias("t"), F.count("*").alias("kinds"))
        evidence = F.zip_with("c", "t", lambda c, t: F.log((c + ADD) / (t + ADD * (F.col("kinds") + 1))))
        return found.join(F.broadcast(every)).select(key, evidence.alias(f"ev_{key}"))  # one row is broadcast

    smooth = lambda prior: F.zip_with("c", prior, lambda c, p: (c + KAPPA * p) / (size("c") + KAPPA))
    domains = counted.where("domain is not null").groupBy("domain").agg(counts).join(F.broadcast(total)).select("domain", smooth("p_all").alias("p_domain"))
    hosts = counted.where("host is not null").groupBy("host", "domain").agg(counts).join(domains, "domain", "left").join(F.broadcast(total))
    hosts = hosts.withColumn("prior", F.coalesce("p_domain", "p_all")).select("host", smooth("prior").alias("p_host"))
    x = scored.join(F.broadcast(total))
    for key, table in (("declared", given_language("declared")), ("suffix", given_language("suffix")), ("host", hosts), ("domain", domains)):
        # rows without the key are many: spread, they don't meet in one task
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("ll", "host"), F.lit(4096)).cast("string"))
        x = x.withColumn("at", F.coalesce(key, spread)).join(table.withColumnRenamed(key, "at"), "at", "left").drop("at")
    parts = both("ll", F.transform(F.coalesce("p_host", "p_domain", "p_all"), lambda x: F.log(x)))
    for key in ("declared", "suffix"):
        parts = both(parts, F.coalesce(f"ev_{key}", F.array_repeat(F.lit(0.0), n)))
    x = x.withColumn("parts", parts).withColumn("top", F.array_max("parts"))
    posterior = 1.0 / F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    known = F.get(F.array(*map(F.lit, names)), (F.array_position("parts", F.col("top")) - 1).cast("int"))  # ties go to the first name
    x = x.withColumn("lang_id", F.coalesce(known, F.lit(UND))).withColumn("posterior", F.coalesce(posterior, F.lit(0.0)))
    return x.withColumn("accepted", (F.col("lang_id") != UND) & (F.col("posterior") >= LEAST)).drop("parts", "top")


def evidence_of_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix): the domain is the host's last two labels; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    return host, F.substring_index(host, ".", -2), F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


RESULT = ("declared", "lang_id", "posterior", "accepted")
MARKUP, TAGS = r"(?is)<html[^>]*\slang=[\"']?([a-z]+)", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>"


def evidence_of_documents(docs: DataFrame, *carried: Column) -> DataFrame:
    """Documents declare nothing (their label trains the classifier), and their source is a host without a domain."""
    none = F.lit(None).cast("string")
    return docs.select(*carried, F.col("text").alias("judged"), none.alias("declared"), F.concat(F.lit("source:"), "source").alias("host"), none.alias("domain"), none.alias("suffix"))


def evidence_of_pages(web: DataFrame, *carried: Column) -> DataFrame:
    host, domain, suffix = evidence_of_url(F.col("url"))
    declared = F.nullif(F.lower(F.regexp_extract("html", MARKUP, 1)), F.lit(""))
    return web.select(*carried, F.regexp_replace("html", TAGS, " ").alias("judged"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))


def judged(evidence: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    return identify(materialize(score(evidence, F.col("judged"), model).drop("judged")), model[0])


def documents(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, declared, lang_id, posterior, accepted for a table of documents."""
    return judged(evidence_of_documents(docs, F.col("doc_id")), model or fit(docs)).select("doc_id", *RESULT)


def pages(web: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """page_id, declared, lang_id, posterior, accepted for raw pages: markup language, address suffix and host all count."""
    return judged(evidence_of_pages(web, F.col("page_id")), model).select("page_id", *RESULT)


def corpus(docs: DataFrame, web: DataFrame) -> DataFrame:
    """doc_id, page_id, declared, lang_id, posterior, accepted for documents and pages together (the other id is null)."""
    none = F.lit(None).cast("long")
    mine = evidence_of_documents(docs, F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"))
    rows = mine.unionByName(evidence_of_pages(web, none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")))
    return judged(rows, fit(docs)).select("doc_id", "page_id", *RESULT)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are accepted, with all their columns.

    Rows are stored once with a number of their own and their evidence; the decision shuffles numbers and evidence only, and texts
    meet the numbers of rejected rows, which are few unless the input is mostly junk."""
    model = fit(docs)
    evidence = evidence_of_documents(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("row")).withColumn("rid", F.monotonically_increasing_id())
    stored = materialize(score(evidence, F.col("judged"), model).drop("judged"))
    rejected = materialize(identify(stored.drop("row"), model[0]).where(~F.col("accepted")).select("rid"))
    return stored.join(rejected, "rid", "left_anti").select("row.*")
