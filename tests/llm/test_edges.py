"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables through every operator, and brute force on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lexivar.llm import ann, decontam, langid, linededup, lmscore, mixing, neardup, pii, quality, warc
from lexivar.llm.common import Scratch

LONG = " ".join(f"w{i} of the" for i in range(8000))
SENTENCE = "the quick brown fox jumps over the lazy dog and runs away from here today"
ROWS = [
    (1, SENTENCE, "en", "a", 1), (2, SENTENCE, "en", "a", 2), (2, SENTENCE, "en", "a", 2), (3, None, None, None, None), (4, "", "en", None, 0), (5, " \n\t", None, "b", 1),
    (None, "some text without an id in it at all", "en", "b", 1), (6, LONG, "en", "b", 1), (7, "123 456", "xx", "c", 1), (8, SENTENCE + "!\nline two is here for all to see\n" + SENTENCE, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named as the operators' own."""
    d = spark.createDataFrame(ROWS, SCHEMA)
    return d.withColumns({"id": F.lit("x"), "size": F.lit("y"), "score": F.lit(None).cast("string"), "h": F.lit(1), "n": F.lit(1)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_mixing(docs, none):
    rows = mixing.entropy_mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    sizes, total = {}, sum(r["size"] for r in rows)
    for r in rows:
        sizes[r["source"]] = r["source_size"]
        assert r["target"] <= 3 * r["source_size"] + 1e-9
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 and sizes[None] == 0
    assert mixing.entropy_mix(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, "t"), (2, 1, "t"), (7, 0, "t"), (7, None, "t"), (None, 1, "t")], "doc_id long, quality int, text string")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert quality.train(none, labels) is None and quality.score(docs, None).first()["score"] == 0.5


def test_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    m = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    x, at, y = r.standard_normal((7, quality.FEATURES)), np.array([0, 3, 3, 7]), np.array([1.0, 0.0, 1.0])
    bag = x, np.arange(21) % 9, np.arange(8) * 3, at
    loss = lambda: -np.mean(y * np.log(m.forward(*bag)[0]) + (1 - y) * np.log(1 - m.forward(*bag)[0])) + quality.DECAY / 2 * (m.p["E"] ** 2).sum()
    for k, g in m.gradients(*bag, y).items():
        i = tuple(0 for _ in g.shape)
        m.p[k][i] += 1e-5
        up = loss()
        m.p[k][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[i]) < 1e-6, k
        m.p[k][i] += 1e-5


def test_edit_join():
    rnd = random.Random(1)

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[:], i
            for j, y in enumerate(b, 1):
                d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
        return d[-1]

    for _ in range(4000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(b))
            if rnd.random() < 0.5:
                b.insert(k, rnd.choice("abc"))
            elif k < len(b):
                b.pop(k)
        b = "".join(b)
        assert linededup.within(a, b) == (lev(a, b) <= 2)
        x, y = sorted((a, b), key=len)
        if len(x) >= 3 and lev(a, b) <= 2:
            index = {(i, x[s : s + n]) for i, (s, n) in enumerate(linededup.segments(len(x)))}
            assert any((i, y[s : s + n]) in index for i, s, n in linededup.probes(len(y), len(x)))


def test_line_dedup(docs, none):
    out = by_id(linededup.line_dedup(docs))
    assert out[1]["n_removed"] == 0 and out[2]["clean_text"] == "" and out[3]["clean_text"] is None and out[4]["clean_text"] == ""
    assert out[8]["clean_text"] == "line two is here for all to see" and out[6]["clean_text"] == LONG
    assert linededup.line_dedup(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, SENTENCE, 1), (2, "lazy dog", 1), (3, "not there", 1), (4, None, 1), (5, "", 1), (None, SENTENCE, 1)], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontam.contained(docs, items).collect()}
    assert got == {(d, i): 1.0 for d in (1, 2, 8) for i in (1, 2)}
    assert decontam.contained(none, items).count() == 0 and decontam.contained(docs, items.where("1 = 0")).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(3, "u", "<p>ü</p>", 1), (1, None, "<p>ü</p>", 1), (2, "a\r\nb", None, 1), (4, "u", "", 1), (None, "u", "<p>ü</p>", 1), (5, "u", "x" * (17 << 20), 1)], "page_id long, url string, html string, body int")
    scratch = Scratch(spark, "test")
    warc.write_warc(pages, f"{scratch.root}/a")
    out = by_id(warc.read_warc(spark, f"{scratch.root}/a"), "page_id")
    assert all(r["verified"] for r in out.values()) and len(out) == 6
    assert (out[3]["record_type"], out[3]["refers_to"], out[1]["record_type"], out[None]["refers_to"], out[4]["refers_to"]) == ("revisit", 1, "response", 1, 2)
    assert out[1]["payload"] == "<p>ü</p>".encode() and out[5]["payload_bytes"] == 17 << 20
    warc.write_warc(pages.where("1 = 0"), f"{scratch.root}/b")
    assert warc.read_warc(spark, f"{scratch.root}/b").count() == 0


def test_warc_damage():
    good = warc.pack_record(1, "u", b"hello", None)
    (whole,) = warc.read_records(memoryview(good))
    assert whole["verified"]
    (cut,) = warc.read_records(memoryview(good[:-9]))
    assert cut["error"] and not cut["verified"]


def test_lm(docs, none):
    out = by_id(lmscore.backoff_scores(docs))
    assert out[3]["n_words"] == 0 and out[3]["score"] == 0 and out[3]["mean_score"] is None and out[2]["n_words"] == 30 and out[None]["score"] < 0
    assert lmscore.backoff_scores(none).count() == 0


def test_neighbours(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [float("nan")] * 8), (64, [None] + [1.0] * 7), (65, [1.0, 2.0]), (None, [1.0] * 8)]
    rows += [(100 + i, rows[0][1]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    got = {}
    for r in ann.nearest(df, lambda x: x % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got[0]) == [(i + 1, 100 + i) for i in range(5)] and set(got) == {0, 50, 100}
    assert sorted(got[100])[0] == (1, 0)
    assert ann.nearest(df.where("1 = 0"), lambda x: x % 50 == 0).count() == 0


def test_pii(spark, docs, none):
    field = pii.train(docs)
    rows = spark.createDataFrame([(1, "mail a.b@c.example.com and 10.0.0.1 or 300.1.1.1"), (2, "card 4111 1111 1111 1111 ok"), (3, "call +1 (517) 555-0938"), (4, None), (5, ""), (6, "4111111111111112")], "doc_id long, text string")
    out = by_id(pii.find_pii(rows, field))
    assert [tuple(out[i][f"n_{k}"] for k in pii.KINDS) for i in range(1, 7)] == [(1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert out[1]["base_spans"] == "email:5:22,ip:27:35" and out[4]["spans"] == ""
    assert pii.find_pii(docs, field).count() == len(ROWS) and pii.find_pii(none, pii.train(none)).count() == 0


def test_near_duplicates(spark, docs, none):
    rnd, words = random.Random(3), [f"x{i}" for i in range(400)]
    rows = [(9, "a b"), (10, "A  b"), (11, "b a")]
    for g in range(12):
        base = [rnd.choice(words) for _ in range(80)]
        for j in range(6):
            copy = list(base)
            for _ in range(j // 2):
                copy[rnd.randrange(80)] = rnd.choice(words)
            rows.append((100 + 10 * g + j, " ".join(copy)))
    sets = {i: ({tuple(w[j : j + 3]) for j in range(len(w) - 2)} or {tuple(w)}) for i, t in rows if (w := t.lower().split())}
    comp = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    out = by_id(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85))
    assert {i: r["component_id"] for i, r in out.items()} == comp and all(r["n_shingles"] == len(sets[i]) for i, r in out.items())
    edge = by_id(neardup.near_duplicates(docs))
    assert edge[3]["n_shingles"] == 0 and edge[2]["component_id"] == 1 and edge[None]["kept"] and edge[4]["kept"]
    assert neardup.near_duplicates(none).count() == 0


def test_language(docs, none):
    out = by_id(langid.identify(docs, langid.train(docs.select("lang", "text"))))
    assert out[1]["lang_pred"] == "en" and {out[i]["lang_pred"] for i in (3, 4, 5, 7)} == {"und"} and out[3]["score"] == 0
    assert by_id(langid.identify(docs, langid.train(none.select("lang", "text"))))[1]["lang_pred"] == "und"
    assert langid.identify(none, langid.train(docs.select("lang", "text"))).count() == 0
