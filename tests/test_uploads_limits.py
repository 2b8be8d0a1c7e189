"""Uploads by content, results that expire, several statements as one, and the exact stream limiter."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.operators import engine, several, uploads
from ledgerloom.streaming import limits

UPLOADS = "upload_id long, a string, n long"


def test_digests_ignore_order_but_not_repeats_or_nulls(spark):
    rows = [(1, "x", 1), (1, "y", 2), (2, "y", 2), (2, "x", 1), (3, "x", 1), (3, "y", 2), (3, "y", 2), (4, None, 1), (5, "-", 1), (6, "null", 1), (7, "", 1)]
    found = uploads.digests(spark.createDataFrame(rows, UPLOADS).repartition(5), "upload_id", ["a", "n"])
    of = {r.upload_id: r.digest for r in found.collect()}
    assert of[1] == of[2] and len(set(of.values())) == 6
    counted = {r.upload_id: r.counted for r in uploads.first_of_each(found, "upload_id").collect()}
    assert counted == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True}
    both = uploads.together(found.where("upload_id in (1, 3)").withColumn("g", F.lit(1)), ["g"]).first()
    assert both.digest == uploads.together(found.where("upload_id in (2, 3)").withColumn("g", F.lit(1)), ["g"]).first().digest
    assert uploads.digests(spark.createDataFrame([], UPLOADS), "upload_id", ["a"]).collect() == []


def test_results_are_computed_once_and_expire(spark, tmp_path):
    results = uploads.Results(spark, f"{tmp_path}/r", lives=100)
    rows = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "y", 5)], UPLOADS)
    found = uploads.digests(rows, "upload_id", ["a", "n"])
    ran = []

    def sums(frame):
        ran.append(frame.count())
        return frame.groupBy("digest").agg(F.sum("n").alias("n"))

    see = lambda now, r=rows, f=found: sorted(x.n for x in results.through(r, f, "upload_id", sums, now).collect())
    assert see(1000) == [1, 5] and ran == [2]
    assert see(1050) == [1, 5] and ran == [2]
    more = spark.createDataFrame([(1, "x", 1), (9, "z", 7)], UPLOADS)
    assert see(1060, more, uploads.digests(more, "upload_id", ["a", "n"])) == [1, 7] and ran == [2, 1]
    assert see(1120) == [1, 5] and ran == [2, 1, 2]
    assert results.expire(1165) == 2 and results.fresh(1165).count() == 2
    (tmp_path / "r" / "at=1150").mkdir()  # a store that never ended has no mark and isn't read
    assert results.fresh(1165).count() == 2


def test_statements_with_other_columns_are_read_together(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n long, bank string").coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame([(2, 0.5)], "n long, fee double").coalesce(1).write.parquet(f"{tmp_path}/two")
    out = several.read_statements(spark, [f"{tmp_path}/one", f"{tmp_path}/two"])
    assert sorted((r.n, r.bank or "", r.fee or 0) for r in out.collect()) == [(1, "a", 0), (2, "", 0.5)]
    assert out.select("source_account").distinct().count() == 2 and out.where("source_account like 'part-%'").count() == 2


def test_figures_together_are_those_of_one_ledger(spark):
    rng = random.Random(3)
    rows, row = [], 0
    for account in (1, 2, 3):
        balance = 10_000
        for k in range(40):
            kind, amount = rng.choice(["CR", "DR"]), rng.randint(1, 5_000)
            balance += amount if kind == "CR" else -amount
            row += 1
            rows.append((account, k + 1, row, f"2024-0{1 + k // 10}-{1 + k % 10:02d}", rng.choice(["Salary april", "EMI payment home loan", "tea", "Cheque bounce charge"]), kind, amount, balance if k % 5 else None))
    ledger = spark.createDataFrame(rows, "account_id long, row_no long, place long, day string, desc string, type string, amount_c long, balance_c long")
    ledger = ledger.withColumn("date", F.to_date("day"))
    own = classify.enriched(ledger.drop("day", "place"))
    one = classify.enriched(ledger.withColumns({"account_id": F.lit(1), "row_no": F.col("place")}).drop("day", "place"))
    listed = [c for c in engine.engine(own).columns if c not in ("account_id", "reals", "drs")]
    got = {r.account_id: r for r in several.figures(own, F.lit("x")).collect()}
    want = {str(r.account_id): r for r in engine.engine(own).collect()} | {"together x": engine.engine(one).first()}
    assert set(got) == set(want)
    for k in want:
        assert [got[k][c] for c in listed] == [want[k][c] for c in listed], k


def brute(requests, most, seconds, refusing):
    out, held = {}, {}
    for event, user, at in sorted(requests, key=lambda r: r[2]):
        if refusing:
            mine = [a for a in held.get(user, []) if a > at - seconds]
            out[event] = (len(mine) + 1, len(mine) + 1 > most)
            held[user] = mine + [at] if len(mine) < most else mine
        else:
            n = sum(u == user and at - seconds < a <= at for _, u, a in requests)
            out[event] = (n, n > most)
    return out


def requests_of(spark, rows):
    frame = spark.createDataFrame(rows, "event_id long, user_id long, at double")
    return frame.select("event_id", "user_id", F.timestamp_micros((F.col("at") * 1_000_000 + 1_700_000_000_000_000).cast("long")).alias("ts"))


@pytest.mark.parametrize("refusing", [False, True])
def test_stream_equals_batch(spark, refusing):
    rng = random.Random(5)
    rows = [(k, rng.choice([1, 1, 1, 2, None]), round(rng.random() * 300, 1 if k % 2 else 5)) for k in range(200)]
    rows += [(1000 + k, 7, 5 + 5.9 * k) for k in range(11)]  # 11 within a minute, across aligned windows
    requests = requests_of(spark, rows)
    got = {r.event_id: (r.recent, r.limited) for r in limits.limited_files(requests, 10, 60, refusing=refusing).collect()}
    assert got == brute(rows, 10, 60, refusing)
    assert got[1010] == (11, True)
    if not refusing:
        assert got == {r.event_id: (r.recent, r.limited) for r in limits.over_limit(requests, 10, 60).collect()}


def test_late_rows_take_their_place_and_old_state_goes(spark, tmp_path):
    batches = [[(k, 1, k * 2.0) for k in range(8)] + [(20, 1, 100.0)], [(30, 1, 5.0), (31, 1, 90.0), (32, 2, 130.0)], [(40, 3, 1000.0)], [(41, 3, 2000.0)]]
    spark.conf.set(*limits.STORE)
    try:
        for k, rows in enumerate(batches):
            requests_of(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{tmp_path}/in/*")
            query = limits.limited_stream(stream, 10, 60, late="120 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
            query.awaitTermination(200)
    finally:
        spark.conf.unset(limits.STORE[0])
    got = {r.event_id: (r.recent, r.limited) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    every = brute([r for b in batches for r in b], 10, 60, False)
    assert got == {k: v for k, v in every.items() if k != 41}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # user 3 alone: its waiting row, its recent one and their timers


def test_no_requests(spark):
    assert limits.limited_files(requests_of(spark, []), 10, 60).collect() == []
