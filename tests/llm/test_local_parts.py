"""Parts of the operators that need no Spark, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grantweave.llm import decontam, fm_dedup, jaccard, lang_id, mtree, pii, suffix_dedup, suffixes, tokens, topics
from grantweave.llm.repeats import Windows, merged

# The base patterns of the contract.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = pii.digits_of(m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}
            if fine[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.ORDER[x[0]]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab12345678900.@_+-() %é", max_size=60))
def test_base_spans(text):
    assert [s for s in pii.spans_of(text) if s[0] in BASE] == plain_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    text = "my card 4111 1111 1111 1111 and GB82 WEST 1234 5698 7654 32."
    assert [k for k, *_ in pii.spans_of(text)] == ["card", "iban"]
    assert pii.score_of(text, *pii.spans_of(text)[0]) > pii.BASE["card"]
    assert pii.redacted("x a@b.co y") == "x <EMAIL> y"


@pytest.mark.parametrize("number", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"])
@pytest.mark.parametrize("after", ["", " Please pay", " Bank", " EUR 500", " 500", "X", "7", "x", " DE89 3704 0044 0532 0130 00", " " + "0" * 9000])
@pytest.mark.parametrize("before", ["", "AB12 ", "pay "])
def test_account_numbers_end_where_they_end(number, after, before):
    text = before + number + after
    found = [(s, e) for k, s, e in pii.spans_of(text) if k == "iban"]
    assert (len(before), len(before) + len(number)) in found
    assert number not in pii.redacted(text)


def test_account_numbers_of_other_countries_and_wrong_ones():
    assert [text[s:e] for text in ["ZZ33 1234 5678 9012 345 OK then"] for k, s, e in pii.spans_of(text) if k == "iban"] == ["ZZ33 1234 5678 9012 345"]
    assert not [k for k, *_ in pii.spans_of("DE88 3704 0044 0532 0130 00 Please") if k == "iban"]


def test_addresses_with_very_long_zero_runs():
    for text in ("0" * 10_001 + ".1.2.3", "0" * 10_000 + "9.1.2.3"):
        assert ("ip", 0, 10_007) in pii.spans_of(text)


def test_spans_of_hard_texts_take_linear_time():
    for text in ("1" * 200_000, "a." * 100_000, "1.1." * 50_000, "@" * 100_000, "+1" + " " * 100_000):
        pii.spans_of(text)


ALPHABET = "aZé1² \n\t'sll!<|endoftext|>中́٣  \x1c\U0001f600՘"


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=ALPHABET, max_size=40)), st.sampled_from(["", "<|endoftext|>", "'ll "]))
def test_token_counts(text, end):
    count = tokens.TwoTier(public_tokenizers.path(tokens.VOCABULARY), {"the": 1})
    assert count(text + end) == len(count.encode.encode(text + end, add_special_tokens=False).ids)


def edited(data, k, rng):
    b = bytearray(data)
    for _ in range(k):
        at, kind = rng.randrange(len(b)), rng.random()
        if kind < 0.4:
            b[at] = 97 + rng.randrange(26)
        elif kind < 0.7:
            del b[at]
        else:
            b.insert(at, 97 + rng.randrange(26))
    return bytes(b)


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_exactly_what_the_budget_allows():
    rng = random.Random(5)
    prose = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    items = [(i, prose(rng.randrange(40, 200))) for i in range(12)]
    index = decontam.Index(items)
    for _ in range(120):
        i, item = rng.choice(items)
        text = prose(150) + edited(item, rng.randrange(int(0.12 * len(item)) + 1), rng) + prose(150)
        d, most = least_edits(item, text), int(decontam.RATE * len(item))
        found = {h[0]: h[1] for h in index.search(text)}
        assert found.get(i) == (d if d <= most else None)


def fewest_edits(item, text):
    """Sellers' table, a row at a time."""
    t, steps = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int)
    for c in item:
        new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (t != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


@pytest.mark.parametrize("size", [8, 9, 12, 13, 14, 15, 16, 24, 25, 26, 40, 100, 199, 200, 201, 224, 225, 300, 399, 400, 401, 600, 1000, 2500, 5000])
def test_items_of_every_length_are_judged_by_one_rule(size):
    rng = random.Random(size)
    prose = lambda n: bytes(rng.choice(b"abcdefghijkl ") for _ in range(n))
    item = prose(size)
    index, passages = decontam.Index([(7, item)]), decontam.passages_of(item)
    assert all(len(w) == min(size, decontam.PASSAGE) for _, w in passages) and passages[-1][0] + len(passages[-1][1]) == size
    for trial in range(8):
        begin = rng.randrange(max(1, size - 450)) if trial % 2 else 0
        piece = item[begin : begin + (450 if trial % 3 else 150)] or item
        text = prose(80) + edited(piece, rng.randrange(int(0.1 * len(piece)) + 1), rng) + prose(80)
        # the least over all passages that are within their budget
        best = min((d for _, w in passages if (d := fewest_edits(w, text)) <= int(decontam.RATE * len(w))), default=None)
        found = index.search(text)
        assert ([x[1] for x in found] or [None]) == [best]
        for item_id, edits, start, end, a, z in found:
            assert item_id == 7 and fewest_edits(item[a:z], text[start:end]) == edits


def test_any_passage_of_a_long_item_is_found():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    item = decontam.normal(item)
    index = decontam.Index([(1, item)])
    for begin in [*range(0, len(item) - 224, 37), len(item) - 224]:
        assert [x[:2] for x in index.search(b"zz yy " + item[begin : begin + 224] + b" xx ww")] == [(1, 0)]
    assert not index.search(bytes(reversed(item)))


@pytest.mark.parametrize("item", [b"quick brown fo", b"quick brown f", b"quick brown fox"])
def test_short_items_with_one_edit_are_found(item):
    index = decontam.Index([(1, item)])
    for i in range(len(item)):
        for changed in (item[:i] + b"#" + item[i + 1 :], item[:i] + item[i + 1 :], item[:i] + b"#" + item[i:]):
            for text in (changed, b"so a " + changed + b" runs"):
                assert [x[0] for x in index.search(text)] == [1] and index.search(text)[0][1] <= 1
    assert not index.search(item[:3] + b"##" + item[5:9] + b"##" + item[11:])


def test_bands_reach_their_recall():
    bands, rows = jaccard.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard.HASHES


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    shared = jaccard.intersections(sets)
    assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_arrays(s):
    x = np.array(s)
    expected = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffixes.suffix_array(x).tolist() == suffixes.by_rank_doubling(x).tolist() == expected
    shared = suffixes.permuted_prefixes(bytes(s), np.array(expected), 12)
    for a, b in zip(expected, expected[1:]):
        n = 0
        while n < 12 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert shared[b] == n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=20), min_size=1, max_size=6, unique_by=tuple), st.data())
def test_shards_report_repeated_windows(rows, data):
    counts = np.array([data.draw(st.sampled_from([1, 1, 2])) for _ in rows])
    seen = Counter(tuple(r[i : i + 3]) for r in rows for i in range(len(r) - 2))
    flags = [[seen[tuple(r[i : i + 3])] > 1 or c > 1 for i in range(len(r) - 2)] for r, c in zip(rows, counts)]
    by_bytes = suffix_dedup.repeated_windows([bytes(r) for r in rows], counts, 3)
    by_words = fm_dedup.repeated_windows([np.array(r, np.uint64).tobytes() for r in rows], counts, 3)
    for f, a, b in zip(flags, by_bytes, by_words):
        spread = [any(x <= i < x + n for x, n in a) for i in range(len(f))]
        assert spread == f == [any(x <= i < x + n for x, n in b) for i in range(len(f))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=300), st.integers(1, 4))
def test_induced_sorting_recurses(s, times):
    x = np.array(s * times)
    expected = suffixes.by_rank_doubling(x).tolist()
    assert suffixes.suffix_array(x).tolist() == expected
    wide, suffixes.NARROW = suffixes.NARROW, 0  # every level as the strings of names are sorted
    try:
        assert suffixes.suffix_array(x).tolist() == expected
    finally:
        suffixes.NARROW = wide


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=20), min_size=1, max_size=6))
def test_matching_statistics(passages):
    s = np.array([x for p in passages for x in [*(w + 2 for w in p), 1]] + [0])
    begin = np.cumsum([0, *(len(p) + 1 for p in passages)])[:-1]
    order = suffixes.by_rank_doubling(s)
    weight = np.arange(len(s) + 1)
    found = fm_dedup.matching_statistics(fm_dedup.FMIndex(s, order), fm_dedup.Prefixes(s, order), weight, s, begin, np.array([len(p) for p in passages]))
    seen = Counter(tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1))
    for b, p in zip(begin.tolist(), passages):
        for i in range(len(p)):
            longest = max((j - i for j in range(i + 1, len(p) + 1) if seen[tuple(p[i:j])] > 1), default=0)
            assert found[b + i] == longest


def test_fm_index_ranks():
    s = np.array([2, 3, 2, 4, 2, 3, 1, 0])
    index = fm_dedup.FMIndex(s)
    low, high = np.array([0]), np.array([len(s)])
    for symbol in (3, 2):
        low, high = index.extend(np.array([symbol]), low, high)
    assert (high - low).tolist() == [2]


def test_segments_cover_all_windows_and_equal_windows_share_anchors():
    rng = np.random.default_rng(3)
    kind = Windows(None, 20, 5, 7)
    shared = rng.integers(0, 4, 50).astype(np.uint8)
    anchors = []
    for _ in range(2):
        s = np.concatenate([rng.integers(0, 4, 37).astype(np.uint8), shared, rng.integers(0, 4, 11).astype(np.uint8)])
        first, n, place, g = kind.segments(s)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(s) - 19
        anchors.append({int(f) + i: int(h) for f, c, h in zip(first, n, g) for i in range(int(c))})
        segment, block, a, count = kind.blocks(first, n, place)
        assert count.sum() == n.sum() and (count > 0).all() and (count <= 7).all()
        for x, b, start, c in zip(segment, block, a, count):
            low, high = place[x] - b * 7, place[x] - b * 7 - 6 + 20
            assert start + c - 1 <= low and high <= start + 20
    assert all(anchors[0][37 + i] == anchors[1][37 + i] for i in range(31))


def test_merged_intervals():
    assert merged([(5, 1), (0, 2), (30, 1)], 4) == [(0, 9), (30, 34)]


def test_language_model_on_held_out_text():
    rng = random.Random(1)
    words = {"xx": ["ada", "oro", "ine", "esto"], "yy": ["kru", "schtz", "wvek", "plok"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    names, table = lang_id.train([(lang, text(lang, 200)) for lang in words for _ in range(5)])
    right = sum(names[int(table[lang_id.trigrams(text(lang, 12))].sum(axis=0).argmax())] == lang for lang in words for _ in range(50))
    assert right >= 98 and names[-1] == lang_id.UND


def test_context_decides_what_a_hexadecimal_run_is():
    run = "24be64439e3e49cf46b2d7c90f3602a3"
    assert [k for k, *_ in pii.spans_of(f'token = "{run}"')] == ["secret"]
    assert not [k for k, *_ in pii.spans_of(f"the digest of that file is {run} and stays here") if k == "secret"]


def test_topic_vectors():
    assert topics.vector_of("") is None and topics.vector_of("a b") is None
    a, b = (np.frombuffer(topics.vector_of(t), np.int16) for t in ("Topic topic other words here", "WORDS topic other"))
    assert abs(np.sqrt((a.astype(float) ** 2).sum()) - topics.UNIT) < 5 and (a == b).all()


def brute_top(vectors, k):
    out = []
    for q, v in vectors.items():
        if q % 3 == 0:
            ranked = sorted(((-int(v @ w), c) for c, w in vectors.items() if c != q))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_trees_search_exactly(seed):
    rng = np.random.default_rng(seed)
    vectors = {i: v for i, v in enumerate(rng.integers(-40, 40, (700, 5)))}
    for i in range(0, 300, 2):
        vectors[i] = vectors[8] if seed % 2 else vectors[i] // 10  # many equal or tied vectors
    groups: dict = {}
    for i, v in vectors.items():
        groups.setdefault(tuple(v), []).append(i)
    v = np.array(list(groups))
    ids = [sorted(g)[:6] for g in groups.values()]
    m2 = float((v * v).sum(axis=1).max())
    pages = mtree.build(v, m2)
    mine = [[ids[e] for e in p["entry"]] if p["leaf"] else [] for p in pages]
    rows = [
        {"dim": 5, "page": i, "leaf": p["leaf"], "vectors": v[p["entry"]].tobytes(), "apart": p["apart"].tobytes(), "radius": p["radius"].tobytes(), "child": p["child"].tobytes()}
        | {"ids": np.array(sum(mine[i], []), np.int64).tobytes(), "slots": np.array(list(map(len, mine[i])), np.int32).tobytes(), "centre": v[0].tobytes()}
        for i, p in enumerate(pages)
    ]
    asked = np.array([q for q in vectors if q % 3 == 0])
    block = mtree.Queries(asked, np.stack([vectors[q] for q in asked.tolist()]), np.full(len(asked), mtree.LOW), 5, m2)
    mtree.Tree(pd.DataFrame(rows)).search(block, np.arange(len(asked)))
    got = [(int(q), r + 1, int(block.id[i, r]), int(block.score[i, r])) for i, q in enumerate(asked) for r in range(5)]
    assert sorted(got) == brute_top(vectors, 5)
