"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct k-word shingles (words lower-cased A-Z; fewer words: the whole sequence). Its
sketch has m registers; register i is the truncated, exponentially spaced minimum of exponential values hashed from
the set, 1 - floor(log_b(min)), kept within 0..q + 1. Registers of a union are the maxima of the registers, so
sketches merge, and two sets agree in a register with a probability near their Jaccard similarity J.

Documents with equal sets collapse first (by a 128-bit fingerprint and the size). Of the rest, those that agree in
all registers of a band are candidates; bands are as many as make a miss at the threshold rarer than one in a million. A
joint likelihood over all registers (how many are equal, greater, less, given both sizes) puts aside pairs that are
far below the threshold; every link is then confirmed on the full sets.

A bucket never emits all its pairs: sketches decide within the bucket which pairs are worth a look, pairs of one
component are not looked at again, and of what lies near the threshold each member names only its likeliest partner. Confirmed
links merge components. Buckets that still have pairs near the threshold between components then meet once more, with
the full sets, in blocks of bounded size: each such pair is tested in the task, which returns only the links that join
components; so do buckets in which a pair was trusted on its sketches and then failed on its sets. So no link between two components is lost,
however large a bucket is, and rows grow with members, not with pairs.

In the last join, of rows with their groups, groups that hold more than one of HOT rows are at most HOT and are broadcast, so a group of copies that holds a
third of all rows is not one task's; the others are joined by shuffle.

Rows: null or wordless texts have an empty set, n_shingles 0, and stand alone. A null id stands alone, kept, with a null component. Repeated ids
with equal texts are one group whose rows all have doc_id = component_id. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, sieve, table
from .text import distinct_per_doc, mix, pieces, shingles, words

ROWS = 6
BASE = 1.02
LIMIT = 2046
REGISTERS = 512
BLOCK = 2048
ITEMS = 1_000_000
HOT = 1000
_U = np.uint64


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def registers(values: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Sketches of the sets (docs x m, uint16); an empty set has zeros only."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, m), np.uint16)
    if not len(full):
        return out
    starts, ends = bounds[full], bounds[full + 1]
    u = np.uint32
    seeds = (mix(np.arange(1, 3 * m + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(u) | u(1)
    low = np.empty((len(full), m), u)
    narrow = (mix(values) >> _U(32)).astype(u)
    # In runs of sets that fit the cache.
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 32768, "right")))
        part, cut = narrow[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
        for i in range(m):
            x = (part ^ seeds[3 * i]) * seeds[3 * i + 1]
            x ^= x >> u(15)
            x *= seeds[3 * i + 2]
            low[at:to, i] = np.minimum.reduceat(x, cut)
        at = to
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32)
    out[full] = np.clip(1 - np.floor(np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint16)
    return out


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood J (0.4 at least, in steps of 0.01) of pairs of sketches, from the counts of registers where a > b, b > a and both agree."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u, v) / np.maximum(u, v)
    grid = np.linspace(0.4, 1, 61)[None, :] * top[:, None]
    log_b = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = log_b(u[:, None] - v[:, None] * grid), log_b(v[:, None] - u[:, None] * grid)
    fit = more[:, None] * np.log(np.maximum(p, 1e-12)) + less[:, None] * np.log(np.maximum(q, 1e-12)) + same[:, None] * np.log(np.maximum(1 - p - q, 1e-12))
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, k: int, m: int) -> DataFrame:
    """docs(id, text) -> (id, n, fp1, fp2, regs)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            hashed, _, _, at = words(data, offsets)
            values, bounds = distinct_per_doc(*shingles(hashed, at, k))
            sums = np.zeros((2, len(values) + 1), _U)
            np.cumsum(mix(values + _U(11)), out=sums[0, 1:])
            np.cumsum(mix(values * _U(3) + _U(29)), out=sums[1, 1:])
            prints = [(s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums]
            regs = [r.tobytes() for r in registers(values, bounds, m)]
            yield pa.record_batch([part.column("id"), pa.array(np.diff(bounds)), pa.array(prints[0]), pa.array(prints[1]), pa.array(regs, pa.binary())], ["id", "n", "fp1", "fp2", "regs"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(sketch, "id long, n long, fp1 long, fp2 long, regs binary")


def packed_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(id, text) -> (id, items): the whole set, sorted, eight bytes a shingle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches):
            hashed, _, _, at = words(data, offsets)
            values, bounds = distinct_per_doc(*shingles(hashed, at, k))
            yield pa.record_batch([part.column("id"), pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["id", "items"])

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "id long, items binary")


def _merged(scratch: Scratch, comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(id, comp) with the components that new links(a, b) join; only the new links are followed, between components."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    comp = scratch.save(comp.unionByName(ends.join(comp, "id", "left_anti").select("id", F.col("id").alias("comp"))), "joined")
    of = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"of_{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    to = components(scratch, between, "between").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return scratch.save(comp.join(to, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "merged")


def _confirm(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b, items_a, items_b) -> those with den * |A n B| >= num * |A u B|, on the full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(confirm, "a long, b long")


class _Bucket:
    """The members of a bucket, or of two of its blocks, in order of id."""

    def __init__(self, group: pa.Table, m: int) -> None:
        ids = group.column("rep").to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[self.order], m
        self.bucket, self.band, i, j = (group.column(c)[0].as_py() for c in ("bucket", "band", "i", "j"))
        self.n = group.column("n").to_numpy().astype(float)[self.order]
        self.own = None if i == j else group.column("own").to_numpy()[self.order]  # pairs within one block are looked at where the block stands alone
        self.regs = np.frombuffer(b"".join(x.as_py() for x in group.column("regs")), np.uint16).reshape(-1, m)[self.order]
        self.earlier = np.ascontiguousarray(self.regs[:, : self.band * ROWS]).reshape(len(ids), self.band, ROWS)
        _, self.label = np.unique(group.column("comp").to_numpy()[self.order], return_inverse=True)

    def partners(self, i: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Later members of other components whose likely similarity with member i is at least `floor`, and that similarity."""
        rest = i + 1 + np.flatnonzero(self.label[i + 1 :] != self.label[i])
        if self.own is not None:
            rest = rest[self.own[rest] != self.own[i]]
        rest = rest[np.minimum(self.n[rest], self.n[i]) >= floor * np.maximum(self.n[rest], self.n[i])]
        rest = rest[(self.regs[rest] == self.regs[i]).mean(1) >= floor]  # registers agree at least as often as J
        if self.band and len(rest):  # a pair that shares an earlier band is looked at there
            rest = rest[~(self.earlier[rest] == self.earlier[i]).all(2).any(1)]
        if not len(rest):
            return rest, np.zeros(0)
        likely = likely_jaccard(self.regs[rest], np.broadcast_to(self.regs[i], (len(rest), self.m)), self.n[rest], np.full(len(rest), self.n[i]))
        return rest[likely >= floor], likely[likely >= floor]

    def merge(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def _dealt(live: DataFrame, blocks) -> DataFrame:
    """A bucket of more than one block is dealt out in pairs of blocks, each of which fits a task."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    live = live.withColumn("blocks", F.ceil(blocks).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return live.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other", "size", "total")


def _candidates(live: DataFrame, m: int, floor: float, least: float, sure: float) -> DataFrame:
    """live(bucket, band, rep, size, total, comp, n, regs) -> (bucket, a, b, trusted): pairs of different components that may be links, by their joint likelihood.

    Pairs far below the threshold are put aside here, on the sketches. A pair far above it joins its two components at once (trusted), so a group of close
    copies gives about as many pairs as it has members. Of the pairs in between, each member returns its likeliest of at least `least`; a bucket
    with more of them returns a row with a = b too.
    """

    def pick(group: pa.Table) -> pa.Table:
        g, out, more = _Bucket(group, m), [], False
        for i in range(len(g.ids) - 1):
            rest, likely = g.partners(i, floor)
            for j in rest[likely >= sure]:
                if g.label[j] != g.label[i]:
                    g.merge(i, j)
                    out.append((g.ids[i], g.ids[j], 1))
            between = np.flatnonzero((likely < sure) & (g.label[rest] != g.label[i]))
            if len(between):
                best = between[likely[between].argmax()]
                named = likely[best] >= least
                if named:
                    out.append((g.ids[i], g.ids[rest[best]], 0))
                more |= len(between) > named
        if more:
            out.append((g.ids[0], g.ids[0], 0))
        return pa.table([pa.array([g.bucket] * len(out), pa.int64()), *(pa.array([int(x[k]) for x in out], pa.int64()) for k in range(3))], ["bucket", "a", "b", "trusted"])

    return _dealt(live, F.col("size") / BLOCK).groupBy("bucket", "i", "j").applyInArrow(pick, "bucket long, a long, b long, trusted long")


def _settled(live: DataFrame, m: int, floor: float, num: int, den: int) -> DataFrame:
    """live(bucket, band, rep, size, total, comp, n, regs, items) -> (a, b): links that join components, after a test of all pairs that may be links on their full sets."""

    def settle(group: pa.Table) -> pa.Table:
        g, out = _Bucket(group, m), []
        sets = [np.frombuffer(x.as_buffer(), _U) for x in group.column("items")]
        sets = [sets[k] for k in g.order]
        at = np.cumsum([0, *map(len, sets)])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        held = np.zeros(codes.max(initial=0) + 1, bool)
        for i in range(len(g.ids) - 1):
            rest, likely = g.partners(i, floor)
            if not len(rest):
                continue
            mine = codes[at[i] : at[i + 1]]
            held[mine] = True
            for j in rest[np.argsort(-likely, kind="stable")]:
                if g.label[j] != g.label[i]:
                    shared = int(np.count_nonzero(held[codes[at[j] : at[j + 1]]]))
                    if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                        g.merge(i, j)
                        out.append((g.ids[i], g.ids[j]))
            held[mine] = False
        return pa.table([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _dealt(live, F.greatest(F.col("size") / BLOCK, F.col("total") / ITEMS)).groupBy("bucket", "i", "j").applyInArrow(settle, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row; links have Jaccard similarity of at least num / den."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    threshold = num / den
    bands = bands_for(threshold)
    m = max(REGISTERS, bands * ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    drawn = scratch.save(sketches(rows, k, m), "sketches")
    sets = drawn.where("n > 0 and id is not null").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.first("regs").alias("regs"))
    reps = scratch.save(sets.select("rep", "n", "regs"), "reps")
    # One row for each band of each distinct set: a hash of the band's registers.
    band = lambda i: F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)
    member = reps.select("rep", "n", F.posexplode(F.array(*[F.xxhash64(band(i)) for i in range(bands)])).alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("bucket"), "band", "n")
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("size > 1")
    member = scratch.save(member.drop("n").join(shared, "bucket"), "member")
    margin = math.sqrt(threshold * (1 - threshold) / m)
    floor, sure = threshold - 4.5 * margin, threshold + 4.5 * margin

    def drawn_of(some: DataFrame) -> DataFrame:
        return sieve(reps, some.select("rep"), "rep")

    def items_of(ids: DataFrame) -> DataFrame:
        """Only documents that are asked for have their sets written out; one document stands for all with an equal set."""
        return packed_sets(sieve(rows, ids, "id").join(ids, "id", "left_semi").dropDuplicates(["id"]), k)

    found = scratch.save(_candidates(member.join(drawn_of(member), "rep").withColumn("comp", F.col("rep")), m, floor, threshold, sure), "found")
    pairs = scratch.save(found.where("a <> b").select("a", "b").distinct(), "pairs")
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    items = scratch.save(items_of(wanted), "items")
    sides = [items.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in ("a", "b")]
    links = scratch.save(_confirm(pairs.join(sides[0], "a").join(sides[1], "b"), num, den), "links")
    scratch.drop("items")
    comp = components(scratch, links, "comp")
    # Buckets with more pairs near the threshold, or with a trusted pair that failed: these are tested where they meet.
    failed = found.where("trusted = 1").join(links, ["a", "b"], "left_anti")
    again = found.where("a = b").select("bucket").unionByName(failed.select("bucket")).distinct()
    open_ = scratch.save(member.join(again, "bucket"), "open")
    if not open_.isEmpty():
        ids = scratch.save(open_.select(F.col("rep").alias("id")).distinct(), "open-ids")
        items = scratch.save(items_of(ids), "open-items")
        live = open_.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        live = live.join(drawn_of(open_), "rep").join(items.withColumnRenamed("id", "rep"), "rep")
        links = scratch.save(_settled(live, m, floor, num, den), "settled")
        scratch.drop("open-items")
        if not links.isEmpty():
            comp = _merged(scratch, comp, links)
    scratch.drop("member", "open", "reps")
    # Back to documents: rows of equal sets share their representative, representatives their component.
    key = drawn.where("n > 0 and id is not null").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    linked = key.join(comp.withColumnRenamed("id", "rep"), "rep", "left").where("copies > 1 or comp is not null").select("fp1", "fp2", "n", "copies", F.coalesce("comp", "rep").alias("comp"))
    linked = scratch.save(linked, "groups")
    rows_ = drawn.where("n > 0 and id is not null").select("id", "n", "fp1", "fp2")
    least, same = rows_.count() // HOT, ["fp1", "fp2", "n"]
    hot, cold = (linked.where(c).drop("copies") for c in (F.col("copies") > least, F.col("copies") <= least))
    rest = rows_.join(F.broadcast(hot.drop("comp")), same, "left_anti").join(cold, same, "left")
    out = rows_.join(F.broadcast(hot), same).unionByName(rest).select("id", "n", F.coalesce("comp", "id").alias("comp"))
    out = out.unionByName(drawn.where("n = 0 or id is null").select("id", "n", F.col("id").alias("comp")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


#: The same by a join of all shingles and a walk along all links: whole tables, but only for small ones.
OP9_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
     s as (select distinct doc_id, s from (select doc_id, array_to_string(w[i:i + 2], ' ') as s from w, unnest(range(1, greatest(len(w) - 1, 2))) as r(i) where len(w) > 0)),
     n as (select doc_id, count(*) as n from s group by doc_id),
     p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (s) where a.doc_id < b.doc_id group by all),
     l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
     e as (select x, y from l union all select y, x from l),
     reach(doc_id, to_id) as (select doc_id, doc_id from w union select reach.doc_id, e.y from reach join e on e.x = reach.to_id),
     c as (select doc_id, min(to_id) as component_id from reach group by doc_id)
select c.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n on n.doc_id = c.doc_id
"""
