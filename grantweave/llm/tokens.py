"""Token counts by a map-side two-tier lookup.

The vocabulary file belongs to a byte-level BPE tokenizer, whose text is first cut into pre-tokens, each
encoded by itself; a text's token count is the sum over its pre-tokens. Tier 1 is a small broadcast table
with the lengths of frequent pre-tokens, learnt from the first ``HEAD`` characters of at most ``SAMPLE`` documents
(it only saves time: its contents never change a count). Tier 2 encodes what tier 1 lacks with the library itself and keeps the
length in a bounded cache of the worker. Pre-tokens are never shuffled.

The pre-token pattern is matched with ``regex``. The two libraries may class a rare character differently, so
a worker compares their cuts around each character beyond Latin-1 when it first meets it; a text holding a
character that they cut apart differently, or the tokenizer's special string, is encoded whole by the library.

A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids pass through one by one; an
empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches

VOCABULARY = "byte_bpe_50k.json"
#: Documents that tier 1 is learnt from, characters of each, entries it holds, bytes of its longest key; entries of a worker's cache, characters of its longest.
SAMPLE, HEAD, ENTRIES, KEY, CACHE, LONGEST = 2000, 8000, 50_000, 24, 1 << 18, 64

# The pre-token pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cut for texts of Latin-1 characters, with its classes spelt out: much faster to match.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r\x20\x85\xa0"
LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{LETTER}{NUMBER}{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTES = byte_letters()


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class TwoTier:
    """A worker's two tiers over one vocabulary file."""

    def __init__(self, path: str, tier1: dict[str, int]):
        self.encode = tokenizer(path)
        self.lengths = dict(tier1)
        self.fixed, self.tier1 = len(tier1), tier1
        self.pattern = regex.compile(PATTERN)
        self.merge = self.encode.model.tokenize
        self.special = [t.content for t in self.encode.get_added_tokens_decoder().values()]
        self.alike: set[str] = set()
        self.unlike: set[str] = set()

    def pieces(self, text: str) -> list[str] | None:
        """The text's pre-tokens; None if it must be encoded in one piece."""
        if any(s in text for s in self.special):
            return None
        try:
            text.encode("latin-1")
            return LATIN.findall(text)
        except UnicodeEncodeError:
            pass
        chars = set(text)
        for c in chars.difference(self.alike, self.unlike):
            if c < "\u0100":
                continue
            probe = f"a{c}b 1{c}2 !{c}! a {c} a\n{c}"
            ours = [m.span() for m in self.pattern.finditer(probe)]
            theirs = [span for _, span in self.encode.pre_tokenizer.pre_tokenize_str(probe)]
            (self.alike if ours == theirs else self.unlike).add(c)
        return self.pattern.findall(text) if chars.isdisjoint(self.unlike) else None

    def length(self, piece: str) -> int:
        """Tokens of one pre-token, by the library's own merges."""
        return len(self.merge(piece.encode().decode("latin-1").translate(BYTES)))

    def __call__(self, text: str) -> int:
        pieces = self.pieces(text)
        if pieces is None:
            return len(self.encode.encode(text, add_special_tokens=False).ids)
        try:
            return sum(map(self.lengths.__getitem__, pieces))
        except KeyError:
            pass
        if len(self.lengths) > self.fixed + CACHE:
            self.lengths = dict(self.tier1)
        lengths, total = self.lengths, 0
        for p in pieces:
            n = lengths.get(p)
            if n is None:
                n = self.length(p)
                if len(p) <= LONGEST:
                    lengths[p] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _worker(vocabulary: str, bc) -> TwoTier:
    return TwoTier(public_tokenizers.path(vocabulary), bc.value)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """``df`` with a column of token counts."""
    spark = df.sparkSession
    small_batches(spark)
    own = TwoTier(public_tokenizers.path(vocabulary), {})
    frequent: Counter = Counter()
    # collect() reads partitions only until the limit is met, where an iterator would shuffle every partition's first rows
    for row in df.select(F.substring(F.col(text), 1, HEAD).alias("t")).where("t is not null").limit(sample).collect():
        frequent.update(p for p in own.pieces(row.t) or () if len(p.encode()) <= KEY)
    tier1 = {p: own.length(p) for p, _ in frequent.most_common(ENTRIES)}
    bc = spark.sparkContext.broadcast(tier1)

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        count = _worker(vocabulary, bc)  # each machine has its own place for the file
        return pd.Series([count(t) for t in texts.fillna("")], dtype="int64")

    return df.withColumn(out, counts(F.col(text)))


def over_budget(df: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per document: its bytes, its tokens, and whether it exceeds ``limit`` tokens."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = count_tokens(docs)
    return n.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
