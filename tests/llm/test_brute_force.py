"""Operators against plain programs that look at everything, on small tables."""

import base64
import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexivar.llm import ann, decontam, langid, linededup, mixing, neardup, pii, quality, warc
from lexivar.llm.common import Scratch, unique_rows

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def classes(items, linked):
    """The least member reachable from each item."""
    comp = {i: i for i in items}
    links = [(a, b) for a in items for b in items if a < b and linked(a, b)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                moved = True
    return comp


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


# -- mixing


def water(sizes, weights=(5, 2, 1), cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    stopped = {}
    while True:
        rest = sum(sizes.values()) - sum(stopped.values())
        free = [s for s in order if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: cap * sizes[s] for s in over}


def test_mix_targets_rates_and_rounding(spark):
    rnd = random.Random(5)
    rows = [(i if i % 7 else None, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "b", "c", None, "d"])) for i in range(900)]
    rows += [(5, "x y z", "a")] * 400 + [(None, "", "b")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.entropy_mix(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(i), str(s), len(t.split())) for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = water(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert math.floor(r["rate"] - 1e-6) <= r["copies"] <= math.ceil(r["rate"] + 1e-6) and r["copies"] <= 3
    for s, target in want.items():
        mine = [len(t.split()) for _, t, x in rows if x == s and t]
        mean = sum(mine) / len(mine)
        lo, hi = -80.0, 80.0
        for _ in range(200):  # the dual by bisection
            lam = (lo + hi) / 2
            mass = sum(n * min(3.0, math.exp(min(lam * n / mean, 50))) for n in mine)
            lo, hi = (lam, hi) if mass < target else (lo, lam)
        for r in got:
            if r["source"] == s and r["size"]:
                assert r["rate"] == pytest.approx(min(3.0, math.exp(min(lo * r["size"] / mean, 50))), rel=1e-3, abs=1e-6)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= max(120, 0.02 * target)
    again = mixing.entropy_mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


# -- quality


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    twice = labels.unionByName(labels.where("doc_id % 3 = 0"))  # repeated labels change nothing
    out = quality.score(docs, quality.train(docs, twice.where(rest != 0))).join(labels, "doc_id").where(rest == 0).collect()
    right = np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in out])
    assert len(out) > 20 and right >= 0.85 and all((r["score"] >= 0.3) for r in out if r["quality"])


def test_words_alone_are_learned(spark):
    """Two kinds of documents that differ in nothing but their words."""
    rnd = random.Random(4)
    good, bad = [["maple", "river", "stone"], ["cabin", "grove", "water"]], [["click", "bonus", "money"], ["order", "cheap", "pills"]]
    rows = [(i, " ".join(rnd.choice(rnd.choice(good if i % 2 else bad)) for _ in range(90)), i % 2) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.score(d, quality.train(d.where("doc_id < 300"), d.where("doc_id < 300"))).join(d, "doc_id").where("doc_id >= 300").collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["quality"]) for r in out]) > 0.95


# -- lines


def brute_lines(rows, min_chars=20):
    """Texts of rows (key, text) without the lines that are not the first of their class."""
    lines = [(k, p, x) for k, t in rows if t is not None for p, x in enumerate(t.split("\n")) if re.search(r"[^ \t\r\f\x0B]", x)]
    texts = sorted({x for _, _, x in lines})
    comp = classes(texts, lambda a, b: min(len(a), len(b)) >= min_chars and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2)
    first = {}
    for k, p, x in lines:
        first[comp[x]] = min(first.get(comp[x], (k, p)), (k, p))
    gone = {(k, p) for k, p, x in lines if (k, p) != first[comp[x]]}
    return {k: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone) for k, t in rows}


def noisy_lines(rnd, n):
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(21, 45))) + "x" for _ in range(40)]
    out = []
    for i in range(n):
        kept = []
        for _ in range(rnd.randint(0, 6)):
            s = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                s[rnd.randrange(len(s))] = rnd.choice("abcdefgh")
            kept.append(rnd.choice(("".join(s), "short", "", "  ", "short one")))
        out.append((i, "\n".join(kept)))
    return out


@pytest.mark.parametrize(("small", "block"), [(64, 1024), (1, 3)])
def test_lines_against_all_pairs(spark, monkeypatch, small, block):
    """Also with all buckets as large ones, in many blocks."""
    monkeypatch.setattr(linededup, "SMALL", small)
    monkeypatch.setattr(linededup, "BLOCK", block)
    monkeypatch.setattr(linededup, "HOT", 10)
    rows = noisy_lines(random.Random(8), 120) + [(500 + i, "a line that stands in many, many documents") for i in range(60)] + [(900, None)]
    got = {r["doc_id"]: r["clean_text"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_rows_that_share_an_id(spark):
    same, other = "a line of some length for all", "another line, which is unique here"
    d = spark.createDataFrame([(1, same), (2, same), (2, other), (None, other), (None, "one more line that nobody else has")], "doc_id long, text string").coalesce(1)
    got = sorted((str(r["doc_id"]), r["clean_text"]) for r in linededup.line_dedup(d).collect())
    assert got == sorted([("1", same), ("2", ""), ("2", other), ("None", ""), ("None", "one more line that nobody else has")])


def brute_links(rows, min_chars=20):
    """For each key, over its lines, the number of other texts within the distance."""
    texts = {x for _, t in rows for x in t.split("\n") if len(x) >= min_chars}
    many = {x: sum(x != y and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in texts) for x in texts}
    return {k: sum(many.get(x, 0) for x in t.split("\n")) for k, t in rows}


@pytest.mark.parametrize(("small", "block"), [(64, 1024), (64, 40), (1, 3)])
def test_links_of_lines_against_all_pairs(spark, monkeypatch, small, block):
    """Each link between different texts counts once, wherever it is found: in buckets of either kind, under several keys, in several blocks."""
    monkeypatch.setattr(linededup, "SMALL", small)
    monkeypatch.setattr(linededup, "BLOCK", block)
    rnd = random.Random(12)
    near = [f"{a}a line of a very large group{b} of near cop\u00efes{c}" for a in ("", "1", "22") for b in "\u20acbcd" for c in ("", *"123456789")]
    rows = [(i, f"{x}\nalone\n{rnd.choice(near)}") for i, x in enumerate(near)] + [(1000 + i, t) for i, t in noisy_lines(rnd, 60)]
    got = {r["doc_id"]: r["n_links"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_links(rows)


def test_links_of_many_long_lines(spark):
    """Beyond the length to which pairs are compared at once."""
    rows = [(i, "a long line, " * 350 + chr(97 + i // 9) + chr(97 + i % 9)) for i in range(80)]
    got = [r["n_links"] for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [79] * 80


def test_many_pairs_at_once():
    rnd = random.Random(3)
    short = ["".join(rnd.choice("ab\u20ac") for _ in range(9)) for _ in range(60)]
    texts = short + ["".join(rnd.choice("ab\u20ac") for _ in range(rnd.randint(9, 11))) for _ in range(60)]
    places = np.zeros((15, 120), np.uint32)
    for k, x in enumerate(texts):
        places[2 : 2 + len(x), k] = [ord(c) + 1 for c in x]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(120)))
    got = linededup.all_within(places, a, b, 9, np.array([len(x) for x in texts])[b] - 9)
    assert got.tolist() == [edits(texts[x], texts[y]) <= 2 for x, y in zip(a, b)]


# -- archives


def test_warc_against_plain_rules(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 16)
    monkeypatch.setattr(warc, "SMALL_PAGE", 2000)
    pages = table(spark, "pages").unionByName(spark.createDataFrame([(10_000 + i, "u", "same page") for i in range(40)] + [(20_000, "u", None), (20_001, "u", ""), (20_002, "u", "y" * 300_000)], "page_id long, url string, html string"))
    path = f"{Scratch(spark, 'test').root}/a"
    warc.write_warc(pages, path)
    warc.write_warc(pages, path)  # replaces what was there
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    rows, first = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}, {}
    for i, body in sorted(rows.items()):
        first.setdefault(body, i)
    assert len(got) == len(rows)
    for i, body in rows.items():
        r = got[i]
        assert r["verified"] and r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[body] == i else ("revisit", first[body]))
        assert r["payload"] == (body if first[body] == i else None)


def test_warc_wrong_digest_and_length():
    import gzip

    good = gzip.decompress(warc.pack_record(1, "u", b"hello", None))
    wrong = gzip.compress(good.replace(b"hello", b"hellx"))
    longer = gzip.compress(good.replace(b"\r\n\r\nhello", b"\r\n\r\nhello!"))
    after = warc.pack_record(2, "u", b"next", None)
    for bad in (wrong, longer):
        a, b = warc.read_records(memoryview(bad + after))
        assert a["error"] and not a["verified"] and b["verified"] and b["id"] == 2


# -- neighbours


def test_neighbours_over_several_blocks(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((30, 16))
    x = (centres[rnd.integers(0, 30, 600)] + 0.4 * rnd.standard_normal((600, 16))).astype(np.float32)
    x[100:110] = x[50]  # ties across blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.nearest(df, lambda i: i % 25 == 0, block=90, query_block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = x.astype(np.float64)
    v /= np.sqrt((v**2).sum(1))[:, None]
    hits = 0
    for q in range(0, 600, 25):
        c = v @ v[q]
        want = sorted((-round(c[j], 12), j) for j in range(600) if j != q)[:5]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - c[j]) < 1e-9 for _, j, s in found)
        hits += len({j for _, j in want} & {j for _, j, _ in found})
    assert hits / (24 * 5) >= 0.9 and [j for _, j, _ in sorted(got[50])][:5] == [100, 101, 102, 103, 104]


def test_most_of_unstructured_vectors_are_not_verified():
    x = np.random.default_rng(1).standard_normal((6000, 64)).astype(np.float32)
    b = ann.Block(np.arange(6000), x, 5)
    for q in range(20):
        b.search(q, x[q], 5)
    assert b.verified < 0.7 * 20 * 6000


# -- personal data


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab1.@-+ 29()%_é") for _ in range(rnd.randint(0, 60))) for _ in range(4000)] + [r["text"] or "" for r in table(spark, "documents").collect()]
    texts += ["a@b@c.d", "x@y.z@w.v", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3", "0001.02.3.0255", "4111-1111 1111 1111", "+1 (2) 34 5678901 190.1", "a..b@c-.d.e."]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    import time

    for t in ("a@b.c " + "a" * 400_000, "1" * 400_000 + " 1.2", "@" * 200_000, "1." * 150_000 + "x", "+1" + "(" * 200_000, "a@" * 100_000 + "b.c"):
        start = time.time()
        pii.base_spans(t)
        assert time.time() - start < 5


def test_the_field_adds_what_a_neighbour_hides(spark):
    """A phone number that runs into the next token's digits fails its check; shapes and equal tokens elsewhere say what it is."""
    rnd = random.Random(2)
    phone = lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    rows = [(i, f"some words before {phone()} and words after it {rnd.randint(1, 99)} ok") for i in range(150)]
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert field.transition.shape == (5, 5) and field.skip.shape == (2, 5, 5) and np.allclose(field.skip[0], field.skip[0].T)
    text = f"some words before {phone()} 190.137.223.204 and words after it"
    base, added = pii.all_spans(text, field)
    assert not any(k == 3 for _, k, _ in base) and any(k == 3 for _, k, _ in added)
    out = pii.find_pii(spark.createDataFrame([(1, text), (2, "nothing 12 here"), (3, None)], "doc_id long, text string"), field).collect()
    assert [r["n_spans"] for r in sorted(out, key=lambda r: r["doc_id"])] == [len(base) + len(added), 0, 0]


# -- near duplicates


def near_rows(rnd, groups=14, size=9):
    vocabulary, rows = [f"x{i}" for i in range(500)], []
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(90)]
        for j in range(size):
            copy = list(base)
            for _ in range(j // 2):
                copy[rnd.randrange(90)] = rnd.choice(vocabulary)
            rows.append((1000 + 20 * g + j, " ".join(copy)))
    return rows


def near_brute(rows, k, num):
    sets = {i: shingles(t, k) for i, t in rows}
    full = [i for i in sets if sets[i]]
    return {i: i for i in sets} | classes(full, lambda a, b: 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])), sets


@pytest.mark.parametrize("block", [2048, 4])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    """Also with buckets of many blocks, and one large group of equal texts."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows(random.Random(9)) + [(5000 + i, "one text that is copied again and again and again") for i in range(70)] + [(6000, None), (6001, ""), (6002, "two words")]
    comp, sets = near_brute(rows, 3, 85)
    out = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=3, num=85).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == comp and all(r["n_shingles"] == len(sets[i]) and r["kept"] == (comp[i] == i) for i, r in out.items())


def test_null_ids_stand_alone(spark):
    text = "a text of some words that stands here three times"
    out = neardup.near_duplicates(spark.createDataFrame([(1, text), (None, text), (None, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]


# -- decontamination


def test_decontamination_against_all_pairs(spark):
    rnd = random.Random(12)
    v = [f"y{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(v) for _ in range(rnd.choice((2, 5, 6, 7, 9, 14, 30, 80))))) for i in range(60)]
    docs = []
    for d in range(150):
        w = [rnd.choice(v) for _ in range(rnd.randint(0, 120))]
        if d % 2:
            part = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, 2)):
                part[rnd.randrange(len(part))] = rnd.choice(v)
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, " ".join(w)))
    want = set()
    for i, t in items:
        k = min(5, len(t.split()))
        own = shingles(t, k)
        for d, x in docs:
            w = x.split()
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(own & have) >= math.ceil(len(own) * 0.8 - 1e-9):
                want.add((d, i))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained(d, b).collect()} == want and len(want) > 20


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_decontamination_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, limit, 0)
    d = spark.createDataFrame([(1, "a b c d e f g h"), (2, "z b c d e f g h i"), (3, "nothing of it")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "b c d e f g h")], "item_id long, text string")
    assert sorted((r["doc_id"], r["containment"]) for r in decontam.contained(d, b).collect()) == [(1, 1.0), (2, 1.0)]


# -- language


def test_language_on_held_out_rows(spark):
    docs = table(spark, "documents")
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    out = langid.identify(docs.select(F.struct("doc_id", "lang").alias("row"), "text"), langid.train(docs.where(rest != 2).select("lang", "text")), id_col="row").select("row.*", "lang_pred").where((rest == 2) & F.col("lang").isNotNull()).collect()
    assert len(out) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.97


def test_filter_returns_all_languages_that_hold_an_ngram():
    """More languages than a word has bits; corrected counts are near the exact ones."""
    rnd = np.random.default_rng(7)
    shared = rnd.integers(0, 1 << 60, 400)
    profiles = [np.unique(np.r_[shared[: 4 * i], rnd.integers(0, 1 << 60, 900)]) for i in range(70)]
    f = langid.Filter([f"l{i:02}" for i in range(70)], profiles, 0)
    code = np.r_[shared, rnd.integers(0, 1 << 60, 600), profiles[69][:500]].astype(np.uint64)
    got = f.hits(code, np.array([0, len(code)]))[0]
    exact = np.array([np.isin(code.astype(np.int64), p).sum() for p in profiles])
    assert np.abs(got - exact).max() <= 12


def test_language_ties_and_unknown_letters(spark):
    d = spark.createDataFrame([(1, "abc abd", "b"), (2, "abc abd", "a"), (3, "abc abd", None), (4, "жжж", None), (5, "12", None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(d, langid.train(d.where("lang is not null").select("lang", "text"))).collect()}
    assert out[3]["lang_pred"] == "a" and out[4]["score"] == 0 and out[5]["lang_pred"] == "und" and out[4]["lang_pred"] in ("a", "b")


# -- rows and the pipeline


def test_unique_rows(spark):
    scratch = Scratch(spark, "test")
    plain = unique_rows(scratch, spark.createDataFrame([(3, "a"), (4, "b")], "id int, t string"), "id", "k")
    assert sorted(r["k"] for r in plain.collect()) == [3, 4]
    for rows, kind in (([(3, "a"), (3, "b")], "int"), ([(3, "a"), (None, "b")], "int"), ([("x", "a"), ("y", "b")], "string")):
        assert len({r["k"] for r in unique_rows(scratch, spark.createDataFrame(rows, f"id {kind}, t string"), "id", "k").collect()}) == 2


PROSE = {
    "en": "the and that with from this they have were been which their would there could about other".split(),
    "de": "der und die nicht mit sich auf auch werden einer durch zwischen wurde konnte haben gegen über".split(),
}


def corpus(rnd):
    rows = []
    for i in range(160):
        lang = rnd.choice(("en", "de"))
        rows.append((i, "\n".join(" ".join(rnd.choice(PROSE[lang]) for _ in range(rnd.randint(6, 14))) for _ in range(rnd.randint(1, 5))), lang, rnd.choice(("a", "b", "c", None)), 1))
    rows += [(200 + i, rows[i][1], "en", "a", 1) for i in range(20)]  # exact copies
    rows += [(300 + i, rows[i][1].replace("the", "xxx", 1), "en", "a", 1) for i in range(20)]
    rows += [(5, "another text under an id that was there: would could about other from this they", "en", "b", 1), (None, rows[3][1] + "\nwhich their would there could about other the and", "en", "b", 1), (None, None, None, None, None)]
    rows += [(400, "12 34 56", "en", "a", 1), (401, "", "de", "a", 1), (402, "жжж ззз ййй", None, "a", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(21)
    rows = corpus(rnd)
    item = " ".join(rnd.choice(PROSE["en"]) for _ in range(30))
    rows += [(600, "first words here " + item + " and that with from", "en", "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "row": F.lit(1), "h": F.lit(2.0), "first": F.lit(None).cast("string"), "size": F.lit(3)})
    docs.coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    scratch, steps = Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf), name)
        steps[name] = (before.collect(), docs.collect())
        if name != "mix":
            assert docs.columns == columns
    texts = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    # Language: what has letters of a known language stays, nothing else.
    was, now = steps["language"]
    assert texts(now) == sorted(x for x in texts(was) if x[1] not in ("None", "", "12 34 56") and "ж" not in x[1])
    # Lines: each row keeps its own text. Ids repeat here, so rows go by their place; equal texts are told apart by how often they stand.
    was, now = steps["lines"]
    keyed = unique_rows(scratch, scratch.save(spark.read.parquet(f"{scratch.root}/language"), "again"), "doc_id", "k").orderBy("k").collect()
    want = brute_lines([(r["k"], r["text"]) for r in keyed])
    assert sum(len(r["text"].split("\n")) for r in now) <= sum(len(r["text"].split("\n")) for r in was)
    left = sorted((str(r["doc_id"]), want[r["k"]]) for r in keyed if want[r["k"]] == r["text"] or want[r["k"]].strip())
    assert len(left) == len(now) and sorted(len(t) for _, t in left) == sorted(len(r["text"]) for r in now)
    assert all(r["n_chars"] == len(r["text"]) or r["n_chars"] == 1 for r in now)
    # Near duplicates: one row of each class.
    was, now = steps["near_duplicates"]
    comp, _ = near_brute(list(enumerate(r["text"] for r in was)), 5, 80)
    assert len(now) == len(set(comp.values()))
    kept = texts(now)
    assert all(x in texts(was) for x in kept)
    # Decontamination: rows that hold the item, whatever their id.
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    own = shingles(item, 5)
    was, now = steps["decontaminate"]
    assert texts(now) == sorted((str(r["doc_id"]), r["text"]) for r in was if len(own & shingles(r["text"], 5)) < math.ceil(0.8 * len(own))) and len(now) < len(was)
    # Mix: words taken come near the targets.
    was, now = steps["mix"]
    sizes = {}
    for r in was:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for s, target in water(sizes).items():
        assert abs(sum(r["taken"] for r in now if r["source"] == s) - target) <= max(60, 0.03 * target)
    ran = corpus_pipeline.run(spark, sf).count()
    assert ran > 0


def test_pipeline_of_an_empty_table(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_stages_keep_rows_of_a_repeated_id(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    long = " ".join(f"u{i}" for i in range(40))
    rows = [(1, long, "en", "a", 1), (1, "v " + item, "en", "a", 1), (1, long, "en", "a", 1), (None, item + " w", "en", "a", 1), (None, "some other text without an id, kept", "en", "a", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.decontaminate(spark, d, sf).collect()
    assert sorted(r["text"] for r in out) == sorted([long, long, "some other text without an id, kept"])
    out = corpus_pipeline.near_duplicate(spark, d, sf).collect()
    assert sorted(r["text"] for r in out if r["text"].startswith("u0")) == [long]
