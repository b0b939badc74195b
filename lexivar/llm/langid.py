"""Language identification by language-bitmask n-gram filters.

Training counts letter trigrams of every training text per language (a trigram packs into 63 bits exactly, so counts are
exact). A language's profile holds every trigram whose rate in it is at least `min_rate`, shared with other languages or not; at most 1 / min_rate
trigrams can reach that, which bounds what is sent to the driver. Profiles go into one bit-sliced Bloom filter: each slot holds one bit for each language, so the AND
of a trigram's k slots returns all languages that contain it (or seem to). A text's score for a language is the
population count of its bit over the text's trigrams, corrected for the language's false-positive rate.

Rows: null texts, empty ones and those without letters are `und` with score 0. Letters that no profile knows give the
language with the most training text, score 0. Null languages and null ids take no part in training. Repeated rows count
as often as they stand. Without training rows everything is `und`. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .text import code_points, mix, pieces

N = 3
MIN_RATE = 2e-5
HASHES = 3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, a space for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams that hold a letter, of each text between two spaces, and each text's first (one more at the end)."""
    cps, at = code_points(data, offsets)
    n = len(at) - 1
    low = np.full(len(cps) + n + 1, 32, np.uint64)
    low[np.arange(len(cps)) + np.repeat(np.arange(n), np.diff(at)) + 1] = _letters()[np.minimum(cps, 0x10FFFF)]
    if len(low) < N:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    code = low[:-2] << np.uint64(42) | low[1:-1] << np.uint64(21) | low[2:]
    first = at + np.arange(n + 1)  # the space before each text
    keep = (low[:-2] != 32) | (low[1:-1] != 32) | (low[2:] != 32)
    cross = np.concatenate([first[1:] - 1, first[1:]])
    keep[cross[(cross >= 0) & (cross < len(keep))]] = False
    seen = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=seen[1:])
    return code[keep], seen[np.minimum(first, len(keep))]


def count_grams(rows: DataFrame) -> DataFrame:
    """rows(lang, text) -> (lang, gram, n), counted within partitions before they are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush(lang: str) -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip(*held[lang]))
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
            return codes[edge], np.add.reduceat(counts, edge) if len(edge) else counts

        for part, data, offsets in pieces(batches):
            langs = part.column("lang").to_pylist()
            code, at = grams(data, offsets)
            of = np.repeat(np.arange(len(langs)), np.diff(at))
            names = np.array(langs, object)
            for lang in set(langs):
                c, n = np.unique(code[(names == lang)[of]], return_counts=True)
                held.setdefault(lang, []).append((c, n))
                if sum(len(x[0]) for x in held[lang]) > 2_000_000:
                    held[lang] = [flush(lang)]
        for lang in held:
            c, n = flush(lang)
            for i in range(0, len(c), 50_000):
                yield pa.record_batch([pa.array([lang] * len(c[i : i + 50_000])), pa.array(c[i : i + 50_000].astype(np.int64)), pa.array(n[i : i + 50_000].astype(np.int64))], ["lang", "gram", "n"])

    return rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """The bit-sliced Bloom filter: slots[s, w] has bit b of language 64 * w + b."""

    def __init__(self, langs: list[str], profiles: list[np.ndarray], default: int) -> None:
        self.langs, self.default = langs, default
        need = max([1024, *(16 * len(p) for p in profiles)])
        self.bits = int(np.ceil(np.log2(need)))
        self.slots = np.zeros((1 << self.bits, max(1, -(-len(langs) // 64))), np.uint64)
        for i, p in enumerate(profiles):
            for s in self.places(p.astype(np.uint64)):
                self.slots[s, i // 64] |= np.uint64(1 << (i % 64))
        self.false = np.array([np.mean(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) ** HASHES for i in range(len(langs))])

    def places(self, code: np.ndarray) -> list[np.ndarray]:
        h = mix(code)
        return [(h >> np.uint64(20 * j) & np.uint64((1 << self.bits) - 1)).astype(np.int64) if self.bits <= 20 else (mix(h + np.uint64(j)) >> np.uint64(64 - self.bits)).astype(np.int64) for j in range(HASHES)]

    def hits(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text and language, how many of the text's n-grams the language holds, less those that chance explains."""
        a, b, c = self.places(code)
        found = self.slots[a] & self.slots[b] & self.slots[c]
        out = np.empty((len(at) - 1, len(self.langs)))
        sums = np.zeros(len(code) + 1, np.int64)
        for i in range(len(self.langs)):
            np.cumsum((found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64), out=sums[1:])
            out[:, i] = sums[at[1:]] - sums[at[:-1]]
        total = np.diff(at)[:, None]
        return np.clip((out - total * self.false) / (1 - self.false), 0, total)


def train(rows: DataFrame, min_rate: float = MIN_RATE) -> Filter:
    """rows(lang, text), all of which are counted; min_rate bounds a profile to 1 / min_rate trigrams."""
    scratch = Scratch(rows.sparkSession, "langid")
    counts = scratch.save(count_grams(rows.where("lang is not null")), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"), "total").where(F.col("rate") >= min_rate)
    kept = rates.groupBy("lang").agg(F.max("total").alias("total"), F.sort_array(F.collect_list("gram")).alias("grams"))
    found = sorted(kept.toLocalIterator(), key=lambda r: r["lang"])
    scratch.drop("counts")
    langs = [r["lang"] for r in found]
    return Filter(langs, [np.array(r["grams"], np.int64) for r in found], max(range(len(langs)), key=lambda i: (found[i]["total"], langs[i]), default=0))


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, coverage) of each row. score: the language's part of all hits; coverage: the part of the text's n-grams that it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part, data, offsets in pieces(batches):
            code, at = grams(data, offsets)
            total, n = np.diff(at), part.num_rows
            if not m.langs:
                best, score, cover, names = np.zeros(n, int), np.zeros(n), np.zeros(n), [UNKNOWN]
            else:
                hits = m.hits(code, at)
                every = hits.sum(1)
                best = np.where(every > 0, hits.argmax(1), m.default)
                top = np.where(every > 0, hits[np.arange(n), best], 0.0)
                score, cover, names = top / np.maximum(every, 1e-9), top / np.maximum(total, 1), m.langs
            lang = pa.array([names[b] if t else UNKNOWN for b, t in zip(best, total)])
            yield pa.record_batch([part.column("id"), lang, pa.array(np.where(total > 0, score, 0.0)), pa.array(np.where(total > 0, cover, 0.0))], ["id", "lang_pred", "score", "coverage"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(predict, f"id {kind}, lang_pred string, score double, coverage double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("lang", "text"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "coverage")
