"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame operations only).

Items and documents are sets of k-word shingles (words lower-cased A-Z). An item is in a document if at least
`threshold` of its shingles are. Items are short and documents long, so their Jaccard similarity says little; instead each
item is sketched by `hashes` minima, each of which a document that contains the item holds with a probability equal to the
containment, whatever the document's length. The number of minima makes a miss at the threshold rarer than one in
a million. Items are partitioned by the power of two of their size; a partition meets only documents large
enough for its least item. Every candidate pair is then verified on the shingles' words themselves.

The sketches are broadcast only while they number at most BROADCAST_ROWS; beyond that they are joined by shuffle.

Rows: null or wordless items and documents match nothing. An item of fewer than k words has one shingle, its whole
sequence, which is looked for among the documents' runs of just as many words. Null ids are left out. Repeated ids give
one row a pair, with the greatest containment. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sieve, table

K = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: str) -> Column:
    split = F.split(F.translate(F.col(text), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.when(F.col(text).isNotNull(), F.filter(split, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def runs(values: str, k: int, make) -> Column:
    """make(slice) of each run of k elements; nothing if there are fewer."""
    n = F.size(values)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: make(F.slice(F.col(values), i, k))))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, item_id, n_item, n_shared, containment) of each pair at or above the threshold."""
    scratch = Scratch(docs.sparkSession, "decontam")
    hashes = math.ceil(math.log(1e-6) / math.log(1 - threshold)) if threshold < 1 else 1
    bench = items.select(F.col(item_id).alias("item"), word_list(item_text).alias("w")).where("item is not null and size(w) > 0")
    bench = bench.withColumn("k", F.least(F.size("w"), F.lit(k)))
    joined = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))
    hashed = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.xxhash64(F.transform(F.slice("w", i, F.col("k")), lambda x: F.xxhash64(x))))
    bench = scratch.save(bench.select("item", "k", F.array_distinct(joined).alias("shingles"), F.array_distinct(hashed).alias("codes")), "items")
    sizes = [r["k"] for r in bench.select("k").distinct().collect()]  # at most k values
    need = F.ceil(F.size("shingles") * F.lit(threshold) - 1e-9)
    bench_ = bench.withColumn("part", F.floor(F.log2(F.size("shingles")))).withColumn("need", need)
    # Whatever shingles a document lacks, it holds one of any (size - need + 1) of them.
    sized = bench_.groupBy("part").agg(F.min("need").alias("least"), F.least(F.max(F.size("shingles") - F.col("need") + 1), F.lit(hashes)).cast("int").alias("minima"))
    bench_ = bench_.join(sized, "part").withColumn("sure", F.size("shingles") - F.col("need") + 1 <= F.col("minima"))
    least_codes = F.slice(F.transform(F.array_sort(F.transform("codes", lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("c")))), lambda x: x["c"]), 1, F.col("minima"))
    # Of each of the hash functions, the item's least shingle; or the least of one function, where so many are sure to meet.
    minima = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("minima")), lambda j: F.array_min(F.transform("codes", lambda c: F.struct(F.xxhash64(c, j).alias("h"), c.alias("c"))))["c"]))
    probes = bench_.select("item", "k", "least", F.explode(F.when(F.col("sure"), least_codes).otherwise(minima)).alias("code"))
    probes = scratch.save(probes, "probes")
    weight = bench.agg(F.coalesce(F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, x: a + F.length(x))), F.lit(0)).alias("n")).first()["n"]
    small = weight <= BROADCAST_BYTES and probes.count() <= BROADCAST_ROWS
    found = None
    for size in sizes:
        side = probes.where(F.col("k") == size).select("item", "code", "least")
        coded = docs.select(F.col(id_col).alias("id"), F.transform(word_list(text), lambda x: F.xxhash64(x)).alias("w")).where("id is not null")
        coded = coded.select("id", (F.size("w") - size + 1).alias("n"), F.explode(runs("w", size, lambda s: F.xxhash64(s))).alias("code"))
        if not small:
            coded = sieve(coded, side.select("code").distinct(), "code")
        one = coded.join(F.broadcast(side) if small else side, "code").where("n >= least").select("id", "item")
        found = one if found is None else found.unionByName(one)
    if found is None:
        kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {item_id} {dict(items.dtypes)[item_id]}, n_item long, n_shared long, containment double")
    pairs = scratch.save(found.distinct(), "pairs")
    hit = pairs.select("id").distinct()
    words_of = docs.select(F.col(id_col).alias("id"), F.col(text).alias("body")).where("id is not null").join(hit, "id", "left_semi")
    words_of = words_of.select("id", word_list("body").alias("w"))
    of_item = bench.select("item", "k", "shingles")
    both = words_of.join(pairs, "id").join(F.broadcast(of_item) if small else of_item, "item")
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - F.col("k") + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))
    both = both.select("id", "item", F.size("shingles").cast("long").alias("n_item"), F.size(F.array_intersect("shingles", own)).cast("long").alias("n_shared"))
    both = both.groupBy("id", "item", "n_item").agg(F.max("n_shared").alias("n_shared"))
    out = both.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = r"""
  select id, array_to_string(w[i:i + 4], ' ') as s, len(w) as n
  from (select {id} as id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from {table}) t,
  unnest(range(1, len(w) - 3)) as r(i)
"""
#: Items of under five words do not occur in these tables, so the SQL leaves their rule out.
OP4_SQL = f"""
with d as (select distinct id, s from ({_SHINGLES.format(id="doc_id", table="documents")})),
     b as (select distinct id, s from ({_SHINGLES.format(id="item_id", table="benchmark")})),
     n as (select id, count(*) as n_item from b group by id),
     m as (select d.id as doc_id, b.id as item_id, count(*) as n_shared from d join b using (s) group by all)
select doc_id, item_id, n_item, n_shared, cast(n_shared as double) / n_item as containment
from m join n on n.id = m.item_id where n_shared >= ceil(n_item * 0.8e0 - 1e-9)
"""
