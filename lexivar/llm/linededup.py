"""Line deduplication by a segment-partition edit join.

Lines are split at line feeds. Two lines are linked if their edit distance (characters) is at most MAX_EDITS = 2. Each
distinct line of at least `min_chars` characters is cut into MAX_EDITS + 1 segments; of two linked lines, one shares
a whole segment of the shorter, near its place. So a line is indexed under (length, segment number, segment), and probes, for each length
from its own down to MAX_EDITS less, the substrings that the multi-match-aware selection leaves. Candidates are verified with a
banded bit-parallel edit distance: one bit for each diagonal of the band, one word for each number of edits.

Linked lines form classes (connected components). The first line of a class, by (row key, line number), stays; all
others are removed. Lines under `min_chars` characters have no links: only equal ones form a class. Blank lines are layout and stay.

Hot lines: a task emits the entries of a line once however often it stands there, so a key meets each line at most once a task. Lines that stand
in more than one of HOT places are at most HOT, so their places are marked by broadcast; the others are joined. Buckets of up to SMALL distinct
lines are joined; larger ones are dealt, with their texts, to tasks in pairs of blocks of about BLOCK lines. Lines that meet under several keys are
taken under the first of them, so each link counts once. A pair of blocks is compared wherever letter counts can be within the distance; it counts
all links of each line and returns those that span its classes: neither a class nor a link in the numbers is lost.
Equal lines are told by 128 bits of hash, links by 64 bits and the texts themselves.

Rows: the row key is the id where ids are unique and not null, else the row's place in the table; so rows that share an id, or have none, keep
their own lines. A null text stays null and has no lines. Empty tables give empty results. Only the id and text columns are read, beside those
named in `keep`, which are handed on in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, components, table, unique_rows

MAX_EDITS = 2
MIN_CHARS = 20
SMALL = 64
BLOCK = 1024
HOT = 1000
#: Pairs of lines compared at once, and the longest lines for which that is done.
BATCH = 1 << 15
LONGEST = 4000
#: Distinct lines a task remembers; beyond them it forgets, and a line may be emitted once more.
REMEMBERED = 1_000_000


def within(a: str, b: str, most: int = MAX_EDITS) -> bool:
    """Whether the edit distance is at most `most`. Bit j of near[e]: so far a's prefix of length i fits b's of length i + j - most with e edits."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    i = 0
    step = 64
    while i < n and a[i : i + step] == b[i : i + step]:
        i += step
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    n, j = min(len(a), len(b)), 0
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return len(a) + len(b) <= most
    where: dict[str, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (k + most)
    band = (1 << (2 * most + 1)) - 1
    near = [0] * (most + 1)
    for e in range(most + 1):
        near[e] = (((1 << (e + 1)) - 1) << most) & band  # i = 0: only insertions
    for i, c in enumerate(a):
        match, before = where.get(c, 0) >> i & band, 0
        new = []
        for e in range(most + 1):
            x = near[e] & match
            if e:
                x |= before | before >> 1 | new[e - 1] << 1 & band
            before = near[e]
            new.append(x)
        near = new
        if not near[most]:
            return False
    return bool(near[most] >> (len(b) - len(a) + most) & 1)


def all_within(places: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, more: np.ndarray, most: int = MAX_EDITS) -> np.ndarray:
    """`within` for many pairs (a[k], b[k]) at once: columns of `places`, whose row most + i holds character i of each line, and 0 beyond its ends.
    All lines a have n characters, each line b has more[k] others in addition."""
    near = [np.full(len(a), ((1 << (e + 1)) - 1) << most & (1 << (2 * most + 1)) - 1, np.uint8) for e in range(most + 1)]
    band = np.uint8((1 << (2 * most + 1)) - 1)
    beside = [places[j][b] for j in range(2 * most)]
    for i in range(n):
        own = places[most + i][a]
        beside.append(places[2 * most + i][b])
        match = np.zeros(len(a), np.uint8)
        for j, c in enumerate(beside):
            match |= (own == c).view(np.uint8) << j
        beside.pop(0)
        new = [near[0] & match]
        for e in range(1, most + 1):
            new.append(near[e] & match | near[e - 1] | near[e - 1] >> 1 | new[e - 1] << 1 & band)
        near = new
        if not near[most].any():
            break
    return (near[most] >> (more + most).astype(np.uint8) & 1).astype(bool)


def segments(n: int, most: int = MAX_EDITS) -> list[tuple[int, int]]:
    """(start, length) of the even partition of a line of n characters, longer segments last."""
    k = most + 1
    short, longer = n // k, n % k
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


@lru_cache(20_000)
def probes(own: int, n: int, most: int = MAX_EDITS) -> list[tuple[int, int, int]]:
    """(segment number, start, length) of the substrings with which a line of `own` characters looks up lines of n <= own."""
    more, out = own - n, []
    for i, (at, size) in enumerate(segments(n, most)):
        lo = max(0, at - i, at + more - (most - i))
        hi = min(own - size, at + i, at + more + (most - i))
        out += [(i, s, size) for s in range(lo, hi + 1)]
    return out


def _seed(n: int, i: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{n}:{i}")


def first_key(shorter: str, longer: str) -> int:
    """The key under which a pair within the distance counts: of the first segment of the shorter line that the longer one looks up and has."""
    n, parts = len(shorter), segments(len(shorter))
    for i, at, size in probes(len(longer), n):
        part = shorter[parts[i][0] : parts[i][0] + size]
        if longer.startswith(part, at):
            return xxhash.xxh3_64_intdigest(part, _seed(n, i))
    raise ValueError("the lines share no segment, so they are not within the distance")


def line_keys(lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """lines(h, line) -> (key, h, probe): the index and probe entries of each line, once a task."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        known: set[int] = set()
        for batch in batches:
            distinct = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            out, own, probe = [], [], []
            for h, s in distinct.items():
                if h in known:
                    continue
                known.add(h)
                n = len(s)
                plan = plans.get(n)
                if plan is None:
                    plan = [(_seed(n, i), at, at + size, False) for i, (at, size) in enumerate(segments(n))]
                    plan += [(_seed(m, i), at, at + size, True) for m in range(max(min_chars, n - MAX_EDITS), n + 1) for i, at, size in probes(n, m)]
                    if len(plans) < 20_000:
                        plans[n] = plan
                for seed, a, b, p in plan:
                    out.append(xxhash.xxh3_64_intdigest(s[a:b], seed))
                    probe.append(p)
                own += [h] * len(plan)
                if len(out) > 200_000:
                    yield pa.record_batch([pa.array(np.array(out, np.uint64).view(np.int64)), pa.array(own, pa.int64()), pa.array(probe)], ["key", "h", "probe"])
                    out, own, probe = [], [], []
            if out:
                yield pa.record_batch([pa.array(np.array(out, np.uint64).view(np.int64)), pa.array(own, pa.int64()), pa.array(probe)], ["key", "h", "probe"])
            if len(known) > REMEMBERED:
                known.clear()

    return lines.mapInArrow(keys, "key long, h long, probe boolean")


def _verify(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, ga, gb, la, lb), a < b -> those within the distance, each one link of both, and the key under which they count."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [(first_key(x, y) if len(x) <= len(y) else first_key(y, x)) if within(x, y) else None for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            keep = pa.array([k is not None for k in key], pa.bool_())
            keys = pa.array(np.array([k for k in key if k is not None], np.uint64).view(np.int64))
            one = pa.array(np.ones(len(keys), np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(keep) for k in range(4)), one, one, keys], ["a", "b", "ga", "gb", "na", "nb", "key"])

    return pairs.select("a", "b", "ga", "gb", "la", "lb").mapInArrow(verify, f"{LINK}, key long")


#: na and nb: how many links of a and of b the row stands for.
LINK = "a long, b long, ga long, gb long, na long, nb long"


def _spanning(group: pa.Table) -> pa.Table:
    """Links that connect all linked lines of two blocks of a large bucket (or of one: i = j), with the number of all links of each line that count
    under the bucket's key. Lines are ordered by a letter count, so that only a run of them can be within the distance."""
    ids, more, texts, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("h", "g", "line", "own"))
    key = group.column("key")[0].as_py() & (1 << 64) - 1
    across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
    sizes = np.array([len(s) for s in texts])
    # What the key stands for, as read from a line that is indexed under it. Without such a line nothing is looked up here.
    plans = {n: [(i, at, size, _seed(n, i)) for i, (at, size) in enumerate(segments(n))] for n in set(sizes.tolist())}
    of = next(((n, i, s[at : at + size]) for n, s in zip(sizes.tolist(), texts) for i, at, size, seed in plans[n] if xxhash.xxh3_64_intdigest(s[at : at + size], seed) == key), None)
    if of is None:
        return _links([])
    n, segment, part = of
    counts = np.zeros((len(ids), 32), np.int32)
    for i, s in enumerate(texts):
        counts[i] = np.bincount(np.frombuffer(s.encode(), np.uint8) & 31, minlength=32)
    # A character of up to four bytes changes at most eight counts.
    slack = np.where([s.isascii() for s in texts], 2 * MAX_EDITS, 8 * MAX_EDITS)
    pick = int(counts.var(0).argmax())
    order = np.argsort(counts[:, pick], kind="stable")
    ids, more, texts, own, sizes, counts, slack = (x[order] for x in (ids, more, texts, own, sizes, counts, slack))
    level = counts[:, pick].copy()
    # Pairs that also meet under an earlier segment count there: `held` has the segments of the indexed lines, `sought` what each line looks up.
    parts, codes = segments(n), {}
    indexed = [k for k in np.flatnonzero(sizes == n).tolist() if texts[k].startswith(part, parts[segment][0])]
    held = {k: [codes.setdefault((i, texts[k][at : at + size]), len(codes)) for i, (at, size) in enumerate(parts[:segment])] for k in indexed}
    looks = [[[codes.get((i, s[at : at + size]), -1) for j, at, size in probes(len(s), n) if j == i] for i in range(segment)] for s in texts]
    width = [max(len(x[i]) for x in looks) for i in range(segment)]
    sought = [(i, np.array([x[i][w] if w < len(x[i]) else -1 for x in looks])) for i in range(segment) for w in range(width[i])]
    places = None
    if n <= LONGEST:
        places = np.zeros((n + 3 * MAX_EDITS, len(ids)), np.uint32)
        for k, s in enumerate(texts):
            places[MAX_EDITS : MAX_EDITS + len(s), k] = np.frombuffer(s.encode("utf-32-le"), np.uint32) + 1
    degree, parent, out, waiting = np.zeros(len(ids), np.int64), list(range(len(ids))), [], []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def compare() -> None:
        a, b = np.repeat([k for k, _ in waiting], [len(x) for _, x in waiting]), np.concatenate([x for _, x in waiting])
        waiting.clear()
        good = np.array([within(texts[x], texts[y]) for x, y in zip(a, b)], bool) if places is None else all_within(places, a, b, n, sizes[b] - n)
        a, b = a[good], b[good]
        np.add.at(degree, a, 1)
        np.add.at(degree, b, 1)
        roots = np.array([find(k) for k in range(len(ids))])
        apart = roots[a] != roots[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = find(i), find(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))

    ready = 0
    for k in indexed:
        lo, hi = np.searchsorted(level, level[k] - 8 * MAX_EDITS, "left"), np.searchsorted(level, level[k] + 8 * MAX_EDITS, "right")
        rest = (sizes[lo:hi] > n) | (ids[lo:hi] > ids[k])
        if across:  # pairs within a block are compared where the block stands alone
            rest &= own[lo:hi] != own[k]
        for i, codes_at in sought:
            rest &= codes_at[lo:hi] != held[k][i]
        rest = lo + np.flatnonzero(rest)
        rest = rest[np.abs(counts[rest] - counts[k]).sum(1) <= np.maximum(slack[rest], slack[k])]
        if len(rest):
            waiting.append((k, rest))
            ready += len(rest)
        if ready >= BATCH:
            compare()
            ready = 0
    if waiting:
        compare()
    rows = []
    for i, j in out:  # each line's links stand beside its first link of those returned
        x, y = sorted((i, j), key=lambda k: ids[k])
        rows.append((ids[x], ids[y], more[x], more[y], degree[x], degree[y]))
        degree[x] = degree[y] = 0
    return _links(rows)


def _links(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([int(x[k]) for x in rows], pa.int64()) for k in range(6)], ["a", "b", "ga", "gb", "na", "nb"])


def split_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, pos, line, h, g) of each line that is not blank; h and g are two hashes of it."""
    lines = docs.select(F.col(key).alias("row"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^ \t\r\f\x0B]")).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def line_links(scratch: Scratch, lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, ga, gb, na, nb): links that give the classes of the lines' distinct texts. A text's na and nb add up to the number of texts it is linked to."""
    entries = line_keys(lines.select("h", "line"), min_chars)
    w = W.partitionBy("key")
    met = entries.withColumns({"lo": F.min("h").over(w), "hi": F.max("h").over(w), "index": F.min(F.col("probe")).over(w), "probed": F.max(F.col("probe")).over(w)})
    live = scratch.save(met.where("lo <> hi and not index and probed").select("key", "h", "probe").distinct(), "live")
    sizes = scratch.save(live.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")
    most = max(SMALL, (sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]) // HOT)
    # Keys with more than one of HOT entries are at most HOT: their entries go to their blocks without meeting on the key.
    hot = sizes.where(F.col("size") > most)
    cold = live.join(F.broadcast(hot.select("key")), "key", "left_anti").join(sizes.where(F.col("size") <= most), "key")
    small, large = cold.where(F.col("size") <= SMALL), cold.where(F.col("size") > SMALL).unionByName(live.join(F.broadcast(hot), "key"))
    pairs = small.where("not probe").select("key", F.col("h").alias("x")).join(small.where("probe").select("key", F.col("h").alias("y")), "key").where("x <> y")
    pairs = scratch.save(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    texts = scratch.save(lines.select("h", "g", "line").join(live.select("h").distinct(), "h", "left_semi").dropDuplicates(["h", "g"]), "texts")
    side = lambda s: texts.select(F.col("h").alias(s), F.col("g").alias(f"g{s}"), F.col("line").alias(f"l{s}"))
    direct = _verify(pairs.join(side("a"), "a").join(side("b"), "b"))
    # Pairs that met in a small bucket, but count in a large one, are counted there.
    direct = direct.join(sizes.where(F.col("size") > SMALL).select("key"), "key", "left_anti").drop("key")
    members = large.select("key", "h", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).distinct()
    own = F.pmod(F.xxhash64("h", F.lit(2)), F.col("blocks")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "h", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    spanned = members.join(texts, "h").groupBy("key", "i", "j").applyInArrow(_spanning, LINK)
    return scratch.save(direct.unionByName(spanned), "links")


def _marked(place: DataFrame, doubled: DataFrame, lines: int) -> DataFrame:
    """place(row, pos, h, g) joined with doubled(h, g, first, n, deg). Lines in more than one of HOT places are at most HOT: they are broadcast."""
    least = lines // HOT
    hot = doubled.where(F.col("n") > least).drop("n")
    cold = place.join(F.broadcast(hot.select("h", "g")), ["h", "g"], "left_anti").join(doubled.where(F.col("n") <= least).drop("n"), ["h", "g"])
    return place.join(F.broadcast(hot), ["h", "g"]).unionByName(cold)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, n_lines, n_removed, n_links, clean_text) of each row, and `row`, a struct of the columns named in keep, if any are; n_links: for each of its
    lines, the number of other texts of lines within the distance, added up."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = unique_rows(scratch, docs, id_col, "__line_row")
    lines = split_lines(docs, "__line_row", text)
    place = scratch.save(lines.select("row", "pos", "h", "g"), "places")
    # A hot line is one row a partition before it is dealt out; where each line stands first is small and known per class.
    once = scratch.save(place.groupBy("h", "g").agg(F.min(F.struct("row", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "once")
    total = once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # A hot line takes part in the join of lines at its first place only.
    hot = once.where(F.col("n") > total // HOT).select("h", "g", "first")
    thin = lines.where(F.length("line") >= min_chars).join(F.broadcast(hot), ["h", "g"], "left").where(F.col("first").isNull() | (F.struct("row", "pos") == F.col("first")))
    links = line_links(scratch, thin, min_chars)
    comp = components(scratch, links, "classes")
    linked = links.select(F.explode(F.array(*[F.struct(F.col(x).alias("h"), F.col(f"g{x}").alias("g"), F.col(f"n{x}").alias("n")) for x in "ab"])).alias("x"))
    linked = linked.groupBy("x.h", "x.g").agg(F.sum("x.n").alias("deg")).join(comp.select(F.col("id").alias("h"), "comp"), "h")
    alone = once.where("n > 1").join(linked, ["h", "g"], "left_anti").select("h", "g", "first", "n", F.lit(0).cast("long").alias("deg"))
    known = once.join(linked, ["h", "g"])
    classes = known.groupBy("comp").agg(F.min("first").alias("head"))
    several = known.join(classes, "comp").select("h", "g", F.col("head").alias("first"), "n", "deg")
    doubled = scratch.save(alone.unionByName(several), "doubled")
    gone = _marked(place, doubled, total).groupBy("row").agg(F.collect_set(F.when(F.struct("row", "pos") != F.col("first"), F.col("pos"))).alias("gone"), F.sum("deg").alias("links"))
    gone = scratch.save(gone, "gone")
    scratch.drop("places", "texts", "pairs", "live", "sizes", "once", "doubled")
    all_lines = F.split(F.col("__line_text"), "\n")
    kept = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = docs.select(F.col("__line_row"), F.col(id_col).alias("__line_id"), F.col(text).alias("__line_text"), F.struct(*keep).alias("__line_keep") if keep else F.lit(None).alias("__line_keep"))
    out = out.join(gone.withColumnRenamed("row", "__line_row").hint("shuffle_hash"), "__line_row", "left")
    removed = F.coalesce(F.size("gone"), F.lit(0))
    return out.select(
        F.col("__line_id").alias(id_col), F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(removed > 0, kept).otherwise(F.col("__line_text")).alias("clean_text"),
        *([F.col("__line_keep").alias("row")] if keep else []),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
