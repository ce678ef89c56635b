"""Alignment of tokenizers, periodic runs and files of token ids against brute force and the tokenizers' own libraries."""

import hashlib
import json
import random
import shutil
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grantweave.llm import align, id_files, token_ids, word_runs

from .test_operators import SCHEMA, rows

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PLAIN.encode_special_tokens = True
OTHER = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PARTS = ["a", "b", " ", "  ", "\n", "é", "ﬁ", "中", "1", "'s", "<|endoftext|>", "<s>", "▁", "!", "\xa0", "　", "the", "\x00", "😀", "\t", "<0x0A>", "İ", "ͅ", "᠎", "\x1c", " "]
ODD = [(900, "x ▁ y"), (901, "<|endoftext|> and <s>"), (902, " "), (903, "  a \n b  "), (904, "w" * 3000), (905, "again and " * 40), (906, "one two " * 9 + "one")]


def table(spark):
    extra = [(i, t, None, None, 0, "x", "y", 1, "z", "h") for i, t in ODD]
    return spark.createDataFrame(rows() + extra, SCHEMA).withColumn("seg", F.lit(1)).withColumn("place", F.lit("p")).repartition(3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_ids_are_the_libraries(text):
    assert token_ids.byte_level().ids(text) == token_ids.packed(LIBRARY.encode(text, add_special_tokens=False).ids)
    assert token_ids.byte_level(plain=True).ids(text) == token_ids.packed(PLAIN.encode(text, add_special_tokens=False).ids)
    assert token_ids.pieces().ids(text) == token_ids.packed(OTHER.encode(text))


def test_ids_with_small_caches(monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE", 3)
    monkeypatch.setattr(token_ids, "TOGETHER", 40)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(300)]
    a, b = token_ids.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), token_ids.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert a.many(texts) == [token_ids.packed(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]
    assert b.many([f" {t}" for t in texts if t]) == [token_ids.packed(OTHER.encode(t)) for t in texts if t]
    assert [b.ids(t) for t in texts] == [token_ids.packed(OTHER.encode(t)) for t in texts]


def aligned(text):
    """(A's ids, B's ids, ends, links, groups) by comparing all ranges; None if there are no tokens."""
    a, b = PLAIN.encode(f" {text}", add_special_tokens=False).ids, OTHER.encode(text)
    spelled = token_ids.byte_level(plain=True).spelled(), token_ids.pieces().spelled()
    if not text or any(b"".join(s[i] for i in ids) != f" {text}".encode() for s, ids in zip(spelled, (a, b))):
        return None
    ranges = []
    for s, ids in zip(spelled, (a, b)):
        ends = np.cumsum([len(s[i]) for i in ids]).tolist()
        ranges.append(list(zip([0, *ends], ends, ids)))
    ends = sorted({e for _, e, _ in ranges[0]} & {e for _, e, _ in ranges[1]})
    links = [(i, j) for s, e, i in ranges[0] for u, v, j in ranges[1] if s < v and u < e]
    groups, at = [], 0
    for end in ends:
        groups.append("|".join(",".join(str(i) for s, e, i in r if at <= s and e <= end) for r in ranges))
        at = end
    return len(a), len(b), len(ends), links, ";".join(groups)


@pytest.mark.parametrize("entries", [1 << 17, 40])
def test_alignment(spark, entries, monkeypatch):
    monkeypatch.setattr(align, "ENTRIES", entries)
    docs = table(spark).where(F.coalesce(F.length("text"), F.lit(0)) < 3500)
    found = [(r.doc_id, aligned(r.text or "")) for r in docs.collect()]
    total = Counter(link for _, d in found if d for link in d[3])
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    expected = Counter()
    for i, d in found:
        if d is None:
            expected[(i, 0, 0, 0, 0, 0, 0, "")] += 1
        else:
            expected[(i, *d[:3], len(d[3]), sum(total[x] == most[x[1]] for x in d[3]), sum(total[x] for x in d[3]), hashlib.sha256(d[4].encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in align.digest(docs).collect()) == expected
    assert align.digest(docs.limit(0)).count() == 0
    if entries > 40:
        shown = align.align(docs, shown=True)
        assert Counter(r.groups for r in shown.where("row is not null").collect()) == Counter(d[4] if d else "" for _, d in found)
        assert {(r.a, r.b): r.n for r in align.pair_counts(shown).collect()} == dict(total)


def runs(words):
    least = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                least.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in least.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=60), st.integers(1, 12), st.integers(0, 40)), max_size=4))
def test_runs(parts):
    texts = [(list(w) + list((w[-p:] or [0]) * n))[:150] for w, p, n in parts]
    assert word_runs.runs_of([np.array(t, np.int64) for t in texts]) == [runs(t) for t in texts]


def test_runs_in_small_portions_and_with_colliding_hashes(monkeypatch):
    rng = random.Random(6)
    texts = [[rng.randrange(2) for _ in range(rng.randrange(90))] + [1, 2, 3] * 8 for _ in range(30)]
    monkeypatch.setattr(word_runs, "PAIRS", 7)
    assert word_runs.runs_of([np.array(t, np.int64) for t in texts]) == [runs(t) for t in texts]
    monkeypatch.setattr(word_runs, "mixed", lambda x: (x & np.uint64(1)) << np.uint64(60))  # hashes that tell little apart
    assert word_runs.runs_of([np.array(t, np.int64) for t in texts]) == [runs(t) for t in texts]


def test_run_digest(spark):
    docs = table(spark)
    expected = Counter()
    for r in docs.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        h = 1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        found = runs(words) if n < 3000 else word_runs.runs_of([np.unique(words, return_inverse=True)[1].astype(np.int64)])[0]
        gone = {i for s, k, q in found for i in range(s + q, s + k)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
        expected[(r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))] += 1
    assert Counter(tuple(r) for r in word_runs.run_digest(docs).collect()) == expected
    assert sum(n for k, n in expected.items() if k[1]) > 3
    assert word_runs.run_digest(docs.limit(0)).count() == 0


def test_id_files(spark, tmp_path):
    docs = table(spark)
    path = str(tmp_path / "ids")
    id_files.write(docs, path, shard_bytes=4000, shard_docs=7)
    texts = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    known = Counter((key[1] if key[0] else None, tuple([*LIBRARY.encode(t, add_special_tokens=False).ids, 0])) for key, t in texts)
    got = id_files.read(spark, path).orderBy("start").collect()
    at = 0
    for r in got:  # starts follow from the lengths, ids ascend
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == known
    manifest = json.load(open(f"{path}/manifest.json"))
    assert len(manifest["shards"]) > 3 and manifest["dictionary"] and all(s["documents"] <= 7 for s in manifest["shards"])
    # one document: only its shard is read, only its frame is unpacked
    one = id_files.read(spark, path).where("doc_id = 62")
    assert ") Filter" not in one._jdf.queryExecution().executedPlan().toString()
    assert [tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in one.collect()] == [k[1] for k in known if k[0] == 62]
    assert {r.doc_id for r in id_files.read(spark, path).where("doc_id >= 60 and doc_id <= 62").collect()} == {60, 61, 62}
    assert sorted(r.doc_id for r in id_files.read(spark, path).where("doc_id in (83, 4, 5555)").collect()) == [4, 83, 83]
    # a dictionary that is not the one the shards name
    other = str(tmp_path / "other")
    shutil.copytree(path, other)
    with open(f"{other}/dictionary-{manifest['dictionary']}.zdict", "wb") as f:
        f.write(b"other")
    with pytest.raises(Exception, match="hash"):
        id_files.read(spark, other).collect()


def test_id_digest(spark):
    docs = table(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in id_files.id_digest(docs).collect()}
    assert got == {(r.doc_id, len(x), zlib.crc32(token_ids.packed(x))) for r in docs.collect() for x in [[*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 0]]}
    assert id_files.id_digest(docs.limit(0)).count() == 0
