"""Queries do the whole job: no cap, window or threshold that their SQL or their name does not state."""

from lexivar.plans import catalog


def test_combine_rounds_takes_every_type(spark, tmp_path):
    rows = [(i, 7, f"t{i:03}") for i in range(150)] + [(900, 7, None), (901, 8, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = {r["user_id"]: r for r in catalog.combine_rounds(spark, str(tmp_path)).collect()}
    assert out[7]["names"] == ",".join(f"t{i:03}:{i}" for i in range(150)) and out[7]["n"] == 151
    assert out[8]["n"] == 1 and out[8]["names"] is None


def test_prompts_of_all_functions_or_a_range(spark):
    lines = spark.createDataFrame([(k, n) for k in (3, 20, 400, 501, 9000) for n in (2, 1)], "l_orderkey long, l_linenumber int")
    orders = spark.createDataFrame([(k, "F" if k == 400 else "O") for k in (3, 20, 400, 501, 9000)], "o_orderkey long, o_orderstatus string")
    keys = lambda *a: sorted(r["l_orderkey"] for r in catalog.prompt_rows(lines, orders, *a).collect())
    assert keys() == [3, 20, 501, 9000]
    assert keys(0, 2) == [3, 20] and keys(1, 3) == [20, 501] and keys(4) == [9000] and keys(2, 1) == [] and keys(0, 999999) == keys()


def test_rare_names_are_not_absent(spark, tmp_path):
    rows = [(10, 1, 0.1, 0.2)] * 1 + [(10, 2, 0.1, 0.2)] * 11 + [(11, k, 0.3, 0.4) for k in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["upper"]: r["n"] for r in catalog.freq_bins_all(spark, str(tmp_path)).collect()} == {0: 1, 10: 1, 100: 1, 1000: 0, 999999: 0}
