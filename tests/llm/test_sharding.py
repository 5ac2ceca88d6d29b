import random
import zlib

from tidemark.llm import sharding


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, key string, size long")


def check(got, rows, shards, tolerance_rows=2):
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for k in range(shards):
        mine = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / shards) <= tolerance_rows * most + 0.002 * total


def test_balance(spark):
    rnd = random.Random(1)
    rows = [(k, "x" * rnd.randrange(200) + str(k), "k", 1) for k in range(3000)]
    check(sharding.shard(frame(spark, rows), shards=16).collect(), rows, 16)


def test_hot_text_is_cut_and_equal_texts_lie_together(spark):
    rows = [(k, "copy " * 20 if k % 2 else f"text {k}", "k", 1) for k in range(4000)] + [(None, None, None, None), (None, "", "", 0), (5, "é", "k", 1), (5, "é", "k", 1)]
    got = sharding.shard(frame(spark, rows), shards=8, cell_rows=100).collect()
    check(got, rows, 8)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    copies = [k for k, r in enumerate(order) if r.text_crc32 == zlib.crc32(("copy " * 20).encode())]
    assert copies[-1] - copies[0] == len(copies) - 1 and len({r.shard for r in order if r.size == 101}) > 1


def test_small_tables(spark):
    assert sharding.shard(frame(spark, [])).count() == 0
    one = sharding.shard(frame(spark, [(1, "a", "k", 1)])).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_no_python_in_the_plan(spark):
    plan = sharding.shard(frame(spark, [(k, str(k), "k", 1) for k in range(50)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_same_result_from_any_partitioning(spark):
    rows = [(k, f"t{k % 37}" * (k % 11), "k", 1) for k in range(500)]
    a = sorted(map(tuple, sharding.shard(frame(spark, rows).repartition(7)).collect()))
    assert a == sorted(map(tuple, sharding.shard(frame(spark, rows).repartition(2)).collect()))
