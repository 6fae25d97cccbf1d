import random

from fablake.operators import pages


def _table(spark, n, tmp_dir, rows_per_block):
    rng = random.Random(3)
    # a third of the rows have one time, some have none
    times = ["2024-01-01 00:00:00" if i % 3 == 0 else None if i % 20 == 1 else f"2024-{rng.randint(1, 12):02d}-07 10:{rng.randint(0, 59):02d}:00" for i in range(n)]
    rows = [(i, t, f"v{i}") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id long, created_at string, _value string").withColumn("created_at", pages.F.col("created_at").cast("timestamp_ntz"))
    brute = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True)
    return pages.store(df, f"{tmp_dir}/t", rows_per_block), [r[0] for r in brute]


def test_pages_equal_a_sorted_list(spark, tmp_dir):
    stored, ids = _table(spark, 1000, tmp_dir, 90)
    assert stored.count() == 1000 and stored.blocks.count() > 5
    for offset, limit in [(0, 10), (85, 20), (500, 100), (333, 1), (995, 10), (1000, 5), (5000, 5), (0, 1000), (10, 0)]:
        page = stored.page(limit, offset)
        assert page.columns == ["id", "created_at", "_value"]
        assert [r.id for r in page.collect()] == ids[offset:offset + limit], (offset, limit)


def test_a_page_reads_only_the_blocks_it_covers(spark, tmp_dir):
    stored, ids = _table(spark, 1000, tmp_dir, 90)
    page = stored.page(5, 700)
    assert len(page.inputFiles()) <= stored.blocks.count()
    block = stored.blocks.filter("first <= 700 and first + n_rows > 700").first()
    read = spark.read.schema(stored.schema).parquet(f"{tmp_dir}/t/rows").filter(pages.F.col("_block") == block["_block"])
    assert read.count() == block["n_rows"] < 400 and {r.id for r in page.collect()} <= {r.id for r in read.collect()} | set(ids[700:705])
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_block" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_empty_table_has_no_pages(spark, tmp_dir):
    stored = pages.store(spark.createDataFrame([], "id long, created_at timestamp_ntz"), f"{tmp_dir}/e")
    assert stored.count() == 0 and stored.page(10, 0).collect() == [] and stored.page(10, 10).collect() == []
