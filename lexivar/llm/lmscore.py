"""Language-model scoring: stupid backoff over n-grams of any order, computed relationally.

S(w | context) = c(context, w) / c(context) where the n-gram stands at least min_count times in the whole corpus, else BACKOFF * S(w | the
context without its first word); without context c(w) / N. A word's context is the order - 1 words before it, or as many as there are. A
document's score is the sum of the logarithms over its words; counts cover all documents.

1. Documents are gathered into chunks of about CHUNK words. A chunk's distinct n-grams of every order go with their counts to partitions by
   hash. So a hot n-gram is one entry a chunk. Rows are packed: one row holds all that a chunk has for a partition; one more row holds its words.
2. In each partition the counts are summed over the chunks and sent back, in the order in which they came.
3. Each chunk makes its n-grams anew from its words, takes their counts and scores its documents.
4. Sums per document; N is the number of all words.

Words are lower-cased A-Z and n-grams named by 48 bits of a hash beside their partition. Rows: null and empty texts have n_words 0, score 0 and a
null mean. Rows that share an id, null included, are one document. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table
from .text import mix, pieces, words

BACKOFF = 0.4
ORDER = 3
MIN_COUNT = 1
BUCKET_BYTES = 4 << 20
CHUNK = 750_000
_U = np.uint64
_NO_ID = -(1 << 63)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, first bytes first, so that planes of like bytes compress. Leads: that width, the length."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpack(b: memoryview) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(pa.py_buffer(b[9:]), n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _grams(h: np.ndarray, length: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of all orders by bucket and name, with bucket and count; for each n-gram that ends at a word, by order, its place among
    them; and each word's place in its document."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
    gram = mix(h)
    every = [gram]
    for k in range(1, order):
        gram = mix(np.r_[_U(0), gram[:-1]][: len(h)] * _U(0x9E3779B97F4A7C15) + h)
        every.append(gram[place >= k])
    keys, which, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    bucket = (mix(keys) % _U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    to = np.empty(len(by), np.int64)
    to[by] = np.arange(len(by))
    return keys[by], bucket[by], n[by], to[which], place


def _deal(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """rows(id, text) -> packed rows (bucket, chunk, keys, n, base); base stands in one row of each chunk only."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []
        chunk, size = TaskContext.get().partitionId() << 32, 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, length = np.concatenate(held), np.concatenate(lengths)
            keys, bucket, n, _, _ = _grams(h, length, order, buckets)
            vocabulary, which, often = np.unique(h, return_inverse=True, return_counts=True)
            # The most frequent words get the least numbers, so that their high bytes compress away.
            rank = np.argsort(-often, kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            vocabulary, which = vocabulary[rank], place[which]
            base = b"".join(len(x).to_bytes(8, "little") + x for x in (np.concatenate(ids).tobytes(), length.tobytes(), vocabulary.tobytes(), _pack(which.astype(_U))))
            out = [(chunk % buckets, chunk, b"", b"", base)]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
            for s, e in zip(edge, np.r_[edge[1:], len(bucket)]):
                name = keys[s:e] >> _U(16)
                out.append((int(bucket[s]), chunk, _pack(np.r_[name[:1], np.diff(name)]), _pack(n[s:e].astype(_U)), b""))
            for i in range(0, len(out), 64):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64]), kinds)], ["bucket", "chunk", "keys", "n", "base"])

        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
        for part, data, offsets in pieces(batches):
            h, _, _, at = words(data, offsets)
            ids.append(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
            lengths.append(np.diff(at).astype(np.int64))
            held.append(h)
            size += len(h)
            if size > CHUNK:
                yield from flush()
                ids, lengths, held, size, chunk = [], [], [], 0, chunk + 1
        if ids:
            yield from flush()

    return rows.mapInArrow(deal, "bucket int, chunk long, keys binary, n binary, base binary")


def _count(group: pa.Table) -> pa.Table:
    """Counts over all chunks, for each row in the order of its keys."""
    bucket, chunk, base = (group.column(c) for c in ("bucket", "chunk", "base"))
    keys, own = [], []
    for k, n in zip(group.column("keys"), group.column("n")):
        k, n = k.as_buffer(), n.as_buffer()
        keys.append(np.cumsum(_unpack(memoryview(k)), dtype=_U) if len(k) else np.zeros(0, _U))
        own.append(_unpack(memoryview(n)) if len(n) else np.zeros(0, _U))
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(own)).astype(_U)[which] if len(which) else np.zeros(0, _U)
    to = np.cumsum([len(k) for k in keys])
    n = [_pack(total[e - len(k) : e]) if len(k) else b"" for k, e in zip(keys, to)]
    return pa.table([chunk, bucket, pa.array(n, pa.binary()), base], ["chunk", "bucket", "n", "base"])


def _score(order: int, min_count: int, buckets: int):
    def score(group: pa.Table) -> pa.Table:
        base, rows = b"", []
        for b, n, x in zip(group.column("bucket").to_pylist(), group.column("n"), group.column("base")):
            n = n.as_buffer()
            if len(n):
                rows.append((b, _unpack(memoryview(n))))
            base = x.as_py() or base
        parts, at = [], 0
        for _ in range(4):
            size = int.from_bytes(base[at : at + 8], "little")
            parts.append(base[at + 8 : at + 8 + size])
            at += 8 + size
        ids, length, vocabulary = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1], np.int64), np.frombuffer(parts[2], _U)
        h = vocabulary[_unpack(memoryview(parts[3])).astype(np.int64)] if len(vocabulary) else np.zeros(0, _U)
        _, _, _, which, place = _grams(h, length, order, buckets)
        counts = np.concatenate([n for _, n in sorted(rows, key=lambda r: r[0])]) if rows else np.zeros(0, _U)
        every = counts[which].astype(np.int64)
        before, alone = np.log(np.maximum(every[: len(h)], 1)), np.ones(len(h), bool)
        value, used = before, len(h)
        for k in range(1, order):
            there = np.flatnonzero(place >= k)
            c = every[used : used + len(there)]
            used += len(there)
            now = np.zeros(len(h))
            now[there] = np.log(np.maximum(c, 1))
            seen = c >= min_count
            value = value.copy()
            value[there] = np.where(seen, now[there] - before[there - 1], value[there] + np.log(BACKOFF))
            alone[there[seen]] = False
            before = now
        doc = np.repeat(np.arange(len(ids)), length)
        s, m = np.bincount(doc, value, minlength=len(ids)).astype(float), np.bincount(doc, alone, minlength=len(ids)).astype(np.int64)
        return pa.table([pa.array(x) for x in (ids, length, s, m)], ["id", "n", "s", "alone"])

    return score


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT) -> DataFrame:
    """(id_col, n_words, score, mean_score) of each document, from n-grams of up to `order` words; those seen less than min_count times back off."""
    if order < 1:
        raise ValueError("order must be at least 1")
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, -(-size // BUCKET_BYTES))
    counted = _deal(rows, order, buckets).groupBy("bucket").applyInArrow(_count, "chunk long, bucket int, n binary, base binary")
    scored = counted.groupBy("chunk").applyInArrow(_score(order, min_count, buckets), "id long, n long, s double, alone long")
    scored = scratch.save(scored, "scored")
    total = scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    score = F.sum("s") - F.sum("alone") * F.lit(float(np.log(max(total, 1))))
    out = scored.groupBy("id").agg(F.sum("n").alias("n_words"), score.alias("score"))
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias(id_col), "n_words", "score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"))


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """Bigrams that stand twice at least, as its SQL has it; op6_lm_score_trigrams takes every n-gram."""
    return _rounded(backoff_scores(table(spark, sf_dir, "documents"), order=2, min_count=2))


def op6_lm_score_trigrams(spark, sf_dir: str) -> DataFrame:
    """Trigrams, with every n-gram that stands at all."""
    return _rounded(backoff_scores(table(spark, sf_dir, "documents"), order=3, min_count=1))


def _rounded(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", F.round("score", 3).alias("score"), F.round("mean_score", 6).alias("mean_score"))


_W = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: The same scores, rounded, as sums of floating numbers depend on their order.
OP6_SQL = f"""
with t as (select doc_id, {_W} as w from documents),
     tok as (select doc_id, i, w[i] as word, case when i > 1 then w[i - 1] end as prev from t, unnest(range(1, len(w) + 1)) as r(i)),
     u as (select word, count(*) as c from tok group by word),
     b as (select prev, word, count(*) as c from tok where prev is not null group by all),
     n as (select count(*) as n from tok),
     s as (select doc_id, case when tok.prev is null then ln(u.c / n) when b.c >= 2 then ln(b.c / p.c) else ln(0.4e0) + ln(u.c / n) end as s
           from tok join u on u.word = tok.word left join u p on p.word = tok.prev left join b on b.prev = tok.prev and b.word = tok.word, n)
select t.doc_id, coalesce(count(s.s), 0) as n_words, round(coalesce(sum(s.s), 0), 3) as score, round(sum(s.s) / nullif(count(s.s), 0), 6) as mean_score
from t left join s on s.doc_id = t.doc_id group by t.doc_id
"""
#: The same for trigrams without a cutoff.
OP6_TRIGRAMS_SQL = f"""
with t as (select doc_id, {_W} as w from documents),
     tok as (select doc_id, i, w[i] as word, case when i > 1 then w[i - 1] end as prev, case when i > 2 then w[i - 2] end as prev2 from t, unnest(range(1, len(w) + 1)) as r(i)),
     u as (select word, count(*) as c from tok group by word),
     b as (select prev, word, count(*) as c from tok where prev is not null group by all),
     g as (select prev2, prev, word, count(*) as c from tok where prev2 is not null group by all),
     n as (select count(*) as n from tok),
     s as (select doc_id, case when g.c >= 1 then ln(g.c / pb.c) when b.c >= 1 then ln(b.c / p.c) + case when tok.prev2 is null then 0 else ln(0.4e0) end
                               else ln(u.c / n) + case when tok.prev is null then 0 when tok.prev2 is null then ln(0.4e0) else 2 * ln(0.4e0) end end as s
           from tok join u on u.word = tok.word left join u p on p.word = tok.prev left join b on b.prev = tok.prev and b.word = tok.word
                left join b pb on pb.prev = tok.prev2 and pb.word = tok.prev left join g on g.prev2 = tok.prev2 and g.prev = tok.prev and g.word = tok.word, n)
select t.doc_id, coalesce(count(s.s), 0) as n_words, round(coalesce(sum(s.s), 0), 3) as score, round(sum(s.s) / nullif(count(s.s), 0), 6) as mean_score
from t left join s on s.doc_id = t.doc_id group by t.doc_id
"""
