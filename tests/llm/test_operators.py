"""The operators on a small table with nulls, empty and long texts, ties, copies and clashing columns, against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grantweave.llm import decontam, fm_dedup, jaccard, lang_id, mixing, mtree, pii, repeats, suffix_dedup, tokens, url_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, hits int, n_bytes string, host string"
WORDS = {"en": "the of and heed onder erble inea thand shore whist".split(), "fr": "le eaux être ouvi queai ément çon aileau ouré".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er", "al", "um"]) for _ in range(n))


def rows():
    rng = random.Random(11)
    long = prose(rng, "en", 4000)
    passage = prose(rng, "fr", 60)
    out = [(i, prose(rng, lang, rng.randrange(20, 120)), lang) for i, lang in enumerate(["en", "fr"] * 12)]
    base = prose(rng, "en", 120).split()
    for i in range(30, 45):  # near copies
        words = list(base)
        words[rng.randrange(len(words))] = f"w{i}"
        out.append((i, " ".join(words), "en"))
    out += [(50 + i, " ".join(base), "en") for i in range(6)]  # exact copies
    out += [(60, prose(rng, "fr", 9) + " " + passage + " x", "fr"), (61, "start " + passage + " " + prose(rng, "fr", 9), "fr")]
    out += [(62, (passage + " ") * 2, "fr"), (70, long, "en"), (71, long[3000:9000], "en"), (72, "ab " * 200, "en"), (73, "é" * 450, None)]
    out += [(80, None, "en"), (81, "", None), (82, "   \n", "fr"), (None, prose(rng, "en", 30), "en"), (None, None, None), (83, "one two", "en"), (83, "one two", "en"), (84, "!!! 123 ???", "en")]
    return [(i, t, lang, f"src{(i or 0) % 3}" if i != 5 else None, len(t or ""), "x", "y", 1, "z", "h") for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def covered(sequences, window):
    seen = Counter(s[i : i + window] for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[s[i : i + window]] > 1:
                flags[i : i + window] = [True] * window
        out.append(flags)
    return out


def test_suffix_dedup(docs, none):
    data = [(r[0], (r[1] or "").encode()) for r in rows()]
    expected = Counter()
    for (i, b), flags in zip(data, covered([b for _, b in data], 200)):
        spans = sum(f and not (j and flags[j - 1]) for j, f in enumerate(flags))
        expected[i, len(b), sum(flags), spans, hashlib.sha256(bytes(x for x, f in zip(b, flags) if not f)).hexdigest()] += 1
    assert got(suffix_dedup.dedup(docs)) == expected
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize(("split", "filtered"), [(1, 1 << 24), (4096, 0)])
def test_dedup_by_cut_up_cores_and_by_joined_anchors(docs, split, filtered, monkeypatch):
    expected = got(suffix_dedup.dedup(docs)), got(fm_dedup.dedup(docs))
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "FILTERED", filtered)
    assert (got(suffix_dedup.dedup(docs)), got(fm_dedup.dedup(docs))) == expected


def test_a_line_that_many_texts_share_is_cut_by_its_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", 4)
    rng = random.Random(9)
    line = prose(rng, "en", 26)
    data = [(i, f"{prose(rng, 'fr', 20)} {line} {prose(rng, 'fr', 20)}") for i in range(60)] + [(i, data) for i in (100, 101) for data in [f"one two three {line} four five six seven eight nine ten"]]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for op, window, units in ((suffix_dedup, 200, lambda t: t.encode()), (fm_dedup, 35, lambda t: tuple(t.split()))):
        known = covered([units(t) for _, t in data], window)
        assert {r.doc_id: r.n_removed for r in op.dedup(df).collect()} == {i: sum(f) for (i, _), f in zip(data, known)}


def test_substring_dedup(docs, none):
    data = [(r[0], tuple((r[1] or "").encode().split())) for r in rows()]
    expected = Counter()
    for (i, w), flags in zip(data, covered([w for _, w in data], 35)):
        expected[i, len(w), sum(flags), hashlib.sha256(b" ".join(x for x, f in zip(w, flags) if not f)).hexdigest()] += 1
    assert got(fm_dedup.dedup(docs)) == expected
    assert fm_dedup.dedup(none).count() == 0


def components(texts):
    """(least id of the component, number of linked texts) by text, by brute force."""
    ids = {}
    for r in texts:
        ids.setdefault(r[1] or "", []).append(r[0])
    sets = {t: frozenset(jaccard.shingles(t).tolist()) for t in ids}
    near = {t: [u for u in ids if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])] for t in ids}
    out = {}
    for t in ids:
        seen, todo = {t}, [t]
        while todo:
            for u in near[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        members = [i for u in seen for i in ids[u] if i is not None]
        out[t] = (min(members, default=None), len(near[t]))
    return out


@pytest.mark.parametrize("block", [128, 4])
def test_jaccard_join(docs, none, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks deal one bucket to many tasks
    known = components(rows())
    assert got(jaccard.join(docs)) == Counter((r[0], *known[r[1] or ""]) for r in rows())
    assert max(n for _, n in known.values()) >= 10
    assert jaccard.join(none).count() == 0


def test_one_document_of_each_class_stays(docs, none):
    known = components(rows())
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {known[r[1] or ""][0] if known[r[1] or ""][0] is not None else r[1] for r in rows()}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(c for c in classes if isinstance(c, int))
    assert kept.count() == len(classes)
    assert jaccard.keep_one(none).count() == 0
    assert jaccard.keep_one(docs.withColumn("extra", F.create_map(F.lit("a"), "lang"))).count() == len(classes)


def test_benchmark_in_rounds(spark, docs, monkeypatch):
    texts = {r[0]: r[1] for r in rows()}
    benchmark = spark.createDataFrame([(i, texts[k]) for i, k in enumerate((2, 4, 60, 70))], "item_id long, text string")
    whole, kept = got(decontam.contaminated(docs, benchmark)), got(decontam.clean(docs.withColumn("hits_", F.lit(1)), benchmark).select("doc_id", "text"))
    monkeypatch.setattr(decontam, "BLOCK", 1)
    assert got(decontam.contaminated(docs, benchmark)) == whole and len(whole) > 4
    clean = decontam.clean(docs.withColumn("hits_", F.lit(1)), benchmark)
    assert clean.columns == [*docs.columns, "hits_"] and got(clean.select("doc_id", "text")) == kept


def test_decontamination(spark, docs, none):
    texts = {r[0]: r[1] for r in rows()}
    items = [(1, texts[60][70:260]), (2, texts[4].upper()), (3, None), (4, "ab"), (5, "nothing of this stands in any of the documents here"), (6, texts[70])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(docs, benchmark).collect()}
    assert found[4, 2] == 0 and found[60, 1] == 0 and found[70, 6] == 0 and (71, 6) in found
    assert {i for _, i in found} == {1, 2, 6}
    clean = decontam.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({d for d, _ in found})
    assert decontam.contaminated(none, benchmark).count() == 0
    assert decontam.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_language(docs, none):
    found = {r.doc_id: r for r in lang_id.documents(docs).collect()}
    for i in range(24):
        assert found[i].lang_id == ("en", "fr")[i % 2] and found[i].accepted
    assert not found[81].accepted and found[80].lang_id == lang_id.UND and not found[84].accepted
    kept = lang_id.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(24))
    assert lang_id.documents(none).count() == 0


def fused(evidence, names):
    """The fusion with dictionaries: evidence is (log-likelihoods or None, declared, host, domain, suffix) by row."""
    import math

    L, clear = range(len(names)), []
    for ll, *keys in evidence:
        if ll is not None:
            w = [math.exp(x - max(ll)) for x in ll]
            if max(w) / sum(w) >= lang_id.CLEAR:
                clear.append((w.index(max(w)), *keys))
    count = lambda at, key: [float(sum(r[0] == i for r in clear if key is None or r[at] == key)) for i in L]
    every = count(0, None)
    p_all = [(c + 1) / (sum(every) + len(names)) for c in every]
    smooth = lambda c, prior: [(x + lang_id.KAPPA * p) / (sum(c) + lang_id.KAPPA) for x, p in zip(c, prior)]

    def given(at, key):
        kinds = {r[at] for r in clear if r[at] is not None}
        if key not in kinds:
            return [0.0] * len(names)
        total = [sum(count(at, k)[i] for k in kinds) for i in L]
        return [math.log((c + 1) / (t + len(kinds) + 1)) for c, t in zip(count(at, key), total)]

    out = []
    for ll, declared, host, domain, suffix in evidence:
        if ll is None:
            out.append((lang_id.UND, 0.0))
            continue
        of_domain = smooth(count(3, domain), p_all) if domain and any(r[3] == domain for r in clear) else None
        prior = smooth(count(2, host), of_domain or p_all) if host and any(r[2] == host for r in clear) else of_domain or p_all
        parts = [x + math.log(p) + a + b for x, p, a, b in zip(ll, prior, given(1, declared), given(4, suffix))]
        w = [math.exp(x - max(parts)) for x in parts]
        out.append((names[w.index(max(w))], max(w) / sum(w)))
    return out


def test_fusion_against_dictionaries(spark, docs):
    """Every third page mixes both languages: markup, suffix and hosts decide there."""
    import re

    model = lang_id.fit(docs)
    rng, pages = random.Random(4), []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        said = lang if rng.random() < 0.8 else ("fr", "en")[i % 2]
        host = rng.choice([f"{lang}{i % 3}.site.org", f"a.{lang}.net", "mixed.site.org"])
        pages.append((i, f"https://{host}/x" if i % 7 else None, f'<html lang="{said}"><body>{prose(rng, lang, 60) if i % 3 else prose(rng, "en", 1) + " " + prose(rng, "fr", 1)}</body></html>' if i % 11 else f"<p>{prose(rng, lang, 2)}</p>"))
    pages += [(200, None, None), (201, "http://x", "<p>12 34</p>"), (5, *pages[5][1:])]
    web = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    evidence = []
    table = model[1].astype("float32")
    for _, url, html in pages:
        text = re.sub(lang_id.TAGS.removeprefix("(?is)"), " ", html or "", flags=re.I | re.S)
        g = lang_id.trigrams(text)
        ll = (table[g].sum(axis=0, dtype=float) * lang_id.TEMPER).tolist() if len(g) else None
        said = re.search(r"<html[^>]*\slang=[\"']?([a-z]+)", html or "")
        host = (url or "").partition("://")[2].split("/")[0] or None
        evidence.append((ll, said and said[1], host, host and ".".join(host.split(".")[-2:]), host.split(".")[-1] if host and "." in host else None))
    known = fused(evidence, model[0])
    found = sorted((r.page_id, r.lang_id, round(r.posterior, 6), r.accepted) for r in lang_id.pages(web, model).collect())
    assert found == sorted((p[0], k[0], round(k[1], 6), k[0] != lang_id.UND and k[1] >= lang_id.LEAST) for p, k in zip(pages, known))
    alone = [None if e[0] is None else model[0][e[0].index(max(e[0]))] for e in evidence]
    assert sum(a is not None and a != k[0] for a, k in zip(alone, known)) > 0  # the other evidence changes something


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    half = F.col("doc_id") % 2 == 0
    model = lang_id.fit(table.where(half))
    found = lang_id.documents(table.where(~half), model).join(table.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 20").collect()
    assert len(found) > 80 and sum(r.lang_id == r.lang for r in found) / len(found) > 0.97


def test_corpus_judges_documents_and_pages(docs, spark):
    web = spark.createDataFrame([(7, "http://a.b/c", "<html lang=fr><p>le eaux être</p></html>")], "page_id long, url string, html string")
    found = lang_id.corpus(docs, web).collect()
    assert len(found) == docs.count() + 1 and [r.page_id for r in found if r.page_id is not None] == [7]
    assert all(r.declared is None for r in found if r.page_id is None)


def test_rare_languages_have_a_class(spark):
    rng = random.Random(3)
    data = [(i, prose(rng, ("en", "fr")[i % 2], 8), ("en", "fr")[i % 2], "src") for i in range(9998)]
    rare = " ".join(rng.choice("και το της ενα λόγος θάλασσα νερό δρόμος".split()) for _ in range(60))
    table = spark.createDataFrame([*data, (9998, rare, "el", "src"), (9999, rare + " ουρανός", "el", "src")], "doc_id long, text string, lang string, source string").repartition(4)
    assert lang_id.fit(table)[0] == ["el", "en", "fr", lang_id.UND]
    assert {r.doc_id for r in lang_id.keep(table).where("lang = 'el'").collect()} == {9998, 9999}
    found = lang_id.fit(table, sample=1)
    assert found[0] == ["el", "en", "fr", lang_id.UND]


def test_pages(spark, docs):
    html = lambda lang, text: f'<!DOCTYPE html><html lang="{lang}"><head><style>x</style></head><body>{text}</body></html>'
    pages = [(i, f"http://h{i % 2}.example.com/{i}", html(("en", "fr")[i % 2], rows()[i][1])) for i in range(20)] + [(90, None, None), (91, "nonsense", "<p>"), (92, "http://h1.example.com/", html("fr", "de la"))]
    web = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in lang_id.pages(web, lang_id.fit(docs)).collect()}
    assert all(found[i].lang_id == ("en", "fr")[i % 2] for i in range(20)) and found[92].lang_id == "fr"
    assert len(found) == 23 and not found[90].accepted


def test_personal_data(spark, none):
    texts = [(1, "mail a.b@c.example.org now"), (1, "mail a.b@c.example.org now"), (2, None), (None, "+1 (555) 010-9999 é 10.0.0.256 10.0.0.255"), (3, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pii", F.lit("clash"))
    found = {r.doc_id: r for r in pii.digest(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[1].spans == "email:5:22" and found[1].base_sha256 == hashlib.sha256(b"email:5:22").hexdigest()
    assert found[2].base_sha256 == found[3].base_sha256 == empty
    assert (found[None].n_phone, found[None].n_ip) == (1, 1)
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[None] == "<PHONE> é 10.0.0.256 <IP>"
    assert pii.digest(none).count() == 0
    assert pii.digest(df).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_tokens(docs, none):
    count = tokens.TwoTier(__import__("public_tokenizers").path(tokens.VOCABULARY), {}).encode
    expected = Counter()
    for r in rows():
        t = r[1] or ""
        n = len(count.encode(t, add_special_tokens=False).ids)
        expected[r[0], len(t.encode()), n, n > 1024] += 1
    assert got(tokens.over_budget(docs)) == expected
    assert tokens.over_budget(none).count() == 0


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/1", "https://x.net", "https://x.net/", "http://example.com/de/5?q=://y.net/", "http://q.org/fr/8", "http://q.org/de/8#a", "http://u@example.com:80/de/", "http://notnet/de/9", "http://z.com/\n/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge(pages).collect()}
    assert found[0] == found[1] == ("", "", None, found[0][3])
    assert found[2] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert found[3][:3] == ("x.net", "", None) and found[4] == ("x.net", "/", "net/", "block")
    assert found[5] == ("example.com", "/de/5", "example.com/de/", "block") and found[6][2:] == ("org/fr/", "allow")
    assert found[7][2] is None and found[8][:3] == ("u@example.com:80", "/de/", None) and found[9][2] is None
    assert found[10][1] == "/\n/x"
    assert url_tree.judge(pages.limit(0)).count() == 0


def test_url_templates_learn_from_rules(spark):
    urls = [f"http://example.com/de/{i}" for i in range(40)] + [f"http://q.org/fr/{i}" for i in range(40)] + [f"http://other.org/{p}/{i}" for p in ("de", "fr") for i in range(5)]
    urls += [f"http://shop.org/{chr(97 + i % 26)}{chr(97 + i // 26)}/list" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_tree.judge(pages).collect()
    assert {r.verdict for r in found if r.host == "other.org" and r.path.startswith("/de/")} == {"block"}
    assert {r.verdict for r in found if r.host == "other.org" and r.path.startswith("/fr/")} == {"allow"}
    assert {r.template for r in found if r.host == "shop.org"} == {"/*/list"}


def test_url_filter_sql_on_deep_and_repeated_urls(spark):
    import duckdb
    import pandas as pd

    slug = lambda i, c: c + chr(97 + i % 26) + chr(97 + i // 26)
    urls = [f"http://example.com/de/b/c/d/e/{slug(i, 'x')}/view/{i % 3}" for i in range(60)] + [f"http://other.org/de/b/c/d/e/{slug(i, 'y')}/view/{i % 3}" for i in range(60)]
    urls = urls + urls[:10] + [f"http://q.org/fr/{i}" for i in range(100)] + [f"http://flat.org/{slug(i, 'z')}" for i in range(40)] + [None, "", "http://a.net"]
    rows = list(enumerate(urls)) + [(3, urls[3]), (None, urls[4])]
    known = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})  # noqa: F841
    expected = Counter(duckdb.sql(url_tree.sql("known")).fetchall())
    assert got(url_tree.judge(spark.createDataFrame(rows, "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict")) == expected


def test_url_templates_of_deep_paths(spark):
    slug = lambda i, c: c + chr(97 + i % 26) + chr(97 + i // 26)
    urls = [f"http://example.com/de/b/c/d/{slug(i, 'x')}/view" for i in range(60)] + [f"http://other.org/de/b/c/d/{slug(i, 'y')}/view" for i in range(60)]
    urls += [f"http://deep.org/1/b/c/d/e/f/g/{slug(i, 'z')}/view" for i in range(33)] + [f"http://q.org/fr/{i}" for i in range(100)]
    found = url_tree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {(r.template, r.verdict) for r in found if r.host == "other.org"} == {("/de/b/c/d/*/view", "block")}
    assert {r.template for r in found if r.host == "deep.org"} == {"/*/b/c/d/e/f/g/*/view"}


def test_mixing(docs, none):
    table = docs.where("text IS NOT NULL")
    found = mixing.mix(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.p <= 1 for r in found)
    massless = {(r.source, r.lang, r.topic) for r in found} - {(r.source, r.lang, r.topic) for r in found if r.tokens}
    assert all(r.p == 0 and not r.selected for r in found if (r.source, r.lang, r.topic) in massless)
    cells = mixing.materialize(mixing.cells_of(mixing.materialize(mixing.describe(table))))
    fitted = mixing.rake(cells, rounds=60).collect()
    for d in mixing.DIMENSIONS:
        target = {r.key: r.share for r in mixing.tempered(cells, d).collect()}
        now = Counter()
        for r in fitted:
            now[r[d]] += r.weight
        assert all(abs(now[k] - v) < 0.05 for k, v in target.items())
    expected, total = sum(r.mass * r.p for r in fitted), sum(r.mass for r in fitted)
    assert abs(expected / total - mixing.FRACTION) < 0.02
    assert set(mixing.sample(docs).columns) == {*docs.columns, "sampling_p"}
    assert mixing.mix(none).count() == 0 and mixing.sample(none).count() == 0


def test_mixing_meets_its_targets_with_production_settings(spark):
    """A bounded raking is known by its shape: targets are met, nothing exceeds what there is, and where a cell isn't taken whole the logarithm
    of its probability is a sum of one term for each marginal."""
    import numpy as np

    rng = random.Random(6)
    cells = [(f"s{i}", lang, topic, float(rng.choice([0, 5, 300, 4000, 90000]) + rng.random()), 1) for i in range(12) for lang in ("en", "fr", None) for topic in range(-1, 5) if rng.random() < 0.7]
    table = spark.createDataFrame(cells, "source string, lang string, topic int, mass double, docs long")
    found = mixing.rake(table).collect()
    total, sums = sum(c[3] for c in cells), {d: Counter() for d in mixing.DIMENSIONS}
    for r in found:
        assert 0 <= r.p <= 1
        for d in mixing.DIMENSIONS:
            sums[d][r[d]] += r.p * r.mass
    for d in mixing.DIMENSIONS:
        target = {r.key: r.share for r in mixing.tempered(table, d).collect()}
        assert abs(sum(target.values()) - 1) < 1e-9
        assert all(abs(sums[d][k] / (mixing.FRACTION * total * v) - 1) < 2 * mixing.TOLERANCE for k, v in target.items())
    part = [r for r in found if r.p < 1 - 1e-9]
    columns = sorted({(d, str(r[d])) for r in found for d in mixing.DIMENSIONS})
    a = np.array([[float(str(r[d]) == k) for d, k in columns] for r in part])
    b = np.log([r.p for r in part])
    assert len(part) < len(found) and np.abs(a @ np.linalg.lstsq(a, b, rcond=None)[0] - b).max() < 1e-6
    report = mixing.marginals(mixing.rake(table)).collect()
    assert len(report) == sum(map(len, sums.values())) and all(abs(r.target - r.reached) < 3e-3 * r.target for r in report)


def test_unreachable_targets_are_reported(spark):
    table = spark.createDataFrame([("a", "en", 0, 10.0, 1), ("b", "fr", 0, 90.0, 1)], "source string, lang string, topic int, mass double, docs long")
    share = lambda **x: spark.createDataFrame(list(x.items()), "key string, share double")
    with pytest.warns(UserWarning, match="marginals"):
        found = {r.source: r.p for r in mixing.rake(table, {"source": share(a=0.9, b=0.1), "lang": share(en=0.1, fr=0.9)}).collect()}
    assert set(found) == {"a", "b"} and all(0 <= p <= 1 for p in found.values())


def test_topics_are_the_nearest_centres(docs):
    from grantweave.llm import topics
    from grantweave.llm.common import materialize

    stored = materialize(mixing.features(docs.select("doc_id", "lang", "text")).drop("text"))
    mean, centres = topics.fit(stored)
    for r, known in ((r, topics.vector_of(r.text or "")) for r in topics.with_topics(stored).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()):
        if known is None:
            assert r.topic == -1
        else:
            import numpy as np

            x = np.frombuffer(known, np.int16).astype(int) - mean.get(r.lang or "", mean[""])
            assert r.topic == int(((centres - x) ** 2).sum(axis=1).argmin())


@pytest.mark.parametrize(("shard", "block"), [(8192, 4096), (40, 4)])
def test_top_k(spark, shard, block, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", shard)
    monkeypatch.setattr(mtree, "BLOCK", block)  # several blocks of queries
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    same = [0.1] * 6
    vectors += [(i, same) for i in range(300, 420)] + [(500, [0.1, None] + same[2:]), (501, [float("nan")] + same[1:]), (502, None), (503, []), (None, same), (550, same), (550, same), (550, [0.2] * 6), (None, [0.3] * 6), (650, []), (600, [0.5, 0.5]), (601, [0.25, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    import numpy as np

    known = []
    for i, v in vectors:
        if v is not None and all(x is not None and x == x for x in v):
            known.append((i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)))
    expected = Counter()
    for row, (q, v) in enumerate(known):
        if q is not None and q % 50 == 0:  # every row but the query's own, repeated ones and those without id included
            best = sorted((-int(v @ w), c is None, c or 0) for other, (c, w) in enumerate(known) if other != row and len(w) == len(v))[:5]
            expected.update((q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(best))
    assert got(mtree.top_k(df)) == expected
    assert mtree.top_k(df.limit(0)).count() == 0
