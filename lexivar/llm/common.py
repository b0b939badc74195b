"""Row keys, and connected components over links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivar.sources.scratch import Scratch, clear  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_rows(scratch: Scratch, docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """docs with a long column `key` that no two rows share: the id itself where ids are whole numbers, unique and never null; else each row's
    place in a copy that is written first, so that later reads agree on it."""
    whole = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    if whole and docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    return scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")


SIEVE_BITS = 1 << 25


def sieve(rows: DataFrame, wanted: DataFrame, column: str, bits: int = SIEVE_BITS) -> DataFrame:
    """Drops most rows whose column has no equal in wanted(column) before they are shuffled; every row with an equal stays, nulls go.

    Values hash to a bitmap of `bits` bits, so what is broadcast never exceeds bits / 8 bytes (4 MiB), however many values there are; with very many
    of them it lets more unwanted rows through to the exact join.
    """
    at = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    slots = wanted.where(F.col(column).isNotNull()).select(F.bitmap_bucket_number(at).alias("slot"), F.bitmap_bit_position(at).alias("pos")).repartition("slot")
    maps = slots.groupBy("slot").agg(F.bitmap_construct_agg("pos").alias("map"))
    byte = F.conv(F.hex(F.substring("map", (F.col("pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("slot", F.bitmap_bucket_number(at)).withColumn("pos", F.bitmap_bit_position(at))
    return placed.join(F.broadcast(maps), "slot").where(F.getbit(byte, (F.col("pos") % 8).cast("int")) == 1).select(*rows.columns)


def components(scratch: Scratch, links: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """links(a, b), both long -> (id, comp): the least id reachable, for ids that have links.

    Each round takes the least label among neighbours, then jumps to that label's own label, so the
    number of rounds follows the logarithm of a component's diameter. No link leaves the executors.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.save(both, f"{label}-edges")
    state = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), f"{label}-0")
    for i in range(1, max_rounds):
        near = both.join(state.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("n"))
        low = state.join(near, "id", "left").select("id", F.least("comp", "n").alias("low"), F.col("comp").alias("was"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("comp"), (F.least("low", F.coalesce("far", "low")) < F.col("was")).alias("moved"))
        new = scratch.save(new, f"{label}-{i}")
        moved = not new.where("moved").isEmpty()
        state = new.select("id", "comp")
        scratch.drop(f"{label}-{i - 1}")
        if not moved:
            return state
    raise RuntimeError("components did not settle")
