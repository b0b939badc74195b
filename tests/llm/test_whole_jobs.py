"""Operators do the whole job, at every setting of their parameters."""

import math
from collections import Counter

import pytest

from lexivar.llm import linededup, lmscore


@pytest.mark.parametrize(("order", "min_count"), [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 3)])
def test_lm_of_any_order_and_cutoff(spark, order, min_count):
    texts = {1: "a b c a b d", 2: "A b c", 3: "x", 4: "x y", 5: "", 6: "c a b c a b d e", 7: "q r s t u"}
    grams = Counter(tuple(w[i - k : i]) for x in texts.values() for w in [x.lower().split()] for k in range(1, 5) for i in range(k, len(w) + 1))
    total = sum(n for g, n in grams.items() if len(g) == 1)

    def s(gram):
        if len(gram) == 1:
            return math.log(grams[gram] / total)
        return math.log(grams[gram] / grams[gram[:-1]]) if grams[gram] >= min_count else math.log(0.4) + s(gram[1:])

    want = {d: sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))) for d, x in texts.items() for w in [x.lower().split()]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lmscore.backoff_scores(docs, order=order, min_count=min_count).collect()}
    assert got == pytest.approx(want)


def test_short_lines_go_by_exact_equality(spark):
    docs = spark.createDataFrame([(1, "Les.\n\nx"), (2, "Les.\n\n \nLes?"), (3, "y\nLes.\n ")], "doc_id long, text string")
    out = {r["doc_id"]: r["clean_text"] for r in linededup.line_dedup(docs).collect()}
    assert out == {1: "Les.\n\nx", 2: "\n \nLes?", 3: "y\n "}
