"""Where programs come from, and whether their project was seen in training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivar.functions.names import project_fragments


def train_fragments(origins: DataFrame) -> DataFrame:
    """(fragment, categories): of the name fragments of training projects, the set of categories in which each stands. A null category is `unknown`."""
    rows = origins.select(F.explode(project_fragments("project")).alias("fragment"), F.coalesce("category", F.lit("unknown")).alias("category"))
    return rows.groupBy("fragment").agg(F.collect_set("category").alias("categories"))


def project_seen(origins: DataFrame, train: DataFrame, exact_only: bool = False) -> DataFrame:
    """origins(binary, project, category), train of the same form -> (binary, seen).

    A project that stands in training is seen. Else the first fragment of its name that stands in training decides: seen if the own category is among that fragment's.
    """
    same = train.select("project").distinct().withColumn("same", F.lit(True))
    x = origins.select("binary", "project", F.coalesce("category", F.lit("unknown")).alias("category")).join(same, "project", "left")
    if exact_only:
        return x.select("binary", F.coalesce("same", F.lit(False)).alias("seen"))
    words = x.where("same is null").select("binary", "category", F.posexplode(project_fragments("project")).alias("at", "fragment"))
    hits = words.join(train_fragments(train), "fragment").select("binary", F.struct("at", F.array_contains("categories", F.col("category")).alias("own")).alias("hit"))
    first = hits.groupBy("binary").agg(F.min("hit")["own"].alias("own"))
    return x.join(first, "binary", "left").select("binary", F.coalesce("same", "own", F.lit(False)).alias("seen"))
