import hashlib
import random
import zlib

import pytest

from ledgerloom.llm.sharding import shard_by_bytes

SCHEMA = "doc_id long, text string, size string, shard int, extra string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "x", 5, f"e{i}") for i, t in rows], SCHEMA).repartition(parts)


def brute(rows, shards):
    order = sorted(rows, key=lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 8 for _, t in order]
    total, before, out, slots = sum(sizes), 0, [], {}
    for (i, t), size in zip(order, sizes):
        shard = (2 * before + size) * shards // (2 * total)
        out.append((i, size, zlib.crc32((t or "").encode()), shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("abé日 \n") for _ in range(rng.choice([0, 1, 10, 300])))) for i in range(150)]
    rows += [(i, "a copy that a third of the rows hold") for i in range(150, 230)] + [(7, "same id and text")] * 30
    return rows + [(None, "no id"), (None, None), (900, None), (901, ""), (902, "long " * 4000)]


@pytest.mark.parametrize("shards,parts", [(24, 4), (1, 1), (7, 6), (1000, 3)])
def test_brute_force(spark, shards, parts):
    rows = case(shards)
    got = [tuple(r) for r in shard_by_bytes(frame(spark, rows, parts), shards).collect()]
    assert sorted(got, key=str) == brute(rows, shards)


def test_shards_are_near_equal_and_gapless(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)]
    out = shard_by_bytes(frame(spark, rows), 24, keep=("extra",))
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "extra"]
    per = out.groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    sizes = [r["sum(size)"] for r in per]
    assert len(per) == 24 and max(sizes) - min(sizes) <= 2 * 58
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in per)
    assert out.where("extra != concat('e', doc_id)").count() == 0


def test_a_third_of_rows_in_one_text_is_dealt_out(spark):
    rows = [(i, "hot") for i in range(1000)] + [(5, "hotter")] * 1000 + [(i, f"t{i}") for i in range(2000)]
    out = shard_by_bytes(frame(spark, rows), 8).collect()
    assert len(out) == 4000 and len({r.shard for r in out if r.size == 11}) > 1 and len({r.shard for r in out if r.size == 14}) > 1


def test_empty_table(spark):
    assert shard_by_bytes(frame(spark, []), 24).collect() == []


def test_no_python(spark):
    plan = shard_by_bytes(frame(spark, [(1, "a")]), 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
