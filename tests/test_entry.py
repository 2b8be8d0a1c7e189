import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_safe_query(spark):
    from ledgerloom.operators import ask
    from ledgerloom.sources import fixtures

    spark.range(3).createOrReplaceTempView("transactions")
    spark.range(1).createOrReplaceTempView("secret")
    spark.range(1).createOrReplaceGlobalTempView("secret")
    q = ask.SafeQuery(spark, ask.view(fixtures.noisy_ledger(spark, "/root/testdata/sf0.001")))
    assert q.run("select * from transactions").count() == 50
    assert ask.SafeQuery(spark, ask.view(fixtures.noisy_ledger(spark, "/root/testdata/sf0.001")), limit=None).run("select * from transactions").count() == 1500
    assert q.run("select id from transactions limit 70").count() == 70
    assert q.run("with t as (select 'no limit' as x) select * from t;").count() == 1
    assert q.run("select count(*) as n from transactions where desc like '%reflect(x)%' or exists (select 1 from transactions t where t.id = 1)").count() == 1
    for bad in (
        "delete from transactions", "select nope from transactions", "drop view transactions", "", "select 1; drop view transactions",
        "select count(*) from parquet.`/root/testdata/sf0.001/orders.parquet`", "select reflect('java.lang.System', 'getProperty', 'user.home')",
        "select java_method('java.lang.System', 'getProperty', 'user.home')", "select * from range(5)", "select (select count(*) from other) from transactions",
        "with t as (select * from csv.`/etc/passwd`) select * from t", "select * from transactions, lateral explode(array(1)) as x", "select current_user() from transactions",
        "select /*+ broadcast(transactions) */ * from transactions", "select input_file_name() from transactions",
        "SELECT `reflect`('java.lang.System','getProperty','user.home') FROM transactions", "select `java_method`('java.lang.System', 'getProperty', 'user.home') from transactions",
        "SELECT a.* FROM secret a, (WITH secret AS (SELECT 1 AS one) SELECT one FROM secret) b", "select * from (select * from (select * from secret))",
        "with t as (with u as (select `reflect`('a', 'b')) select * from u) select * from t", "select * from transactions where id in (select id from secret)",
        "select * from transactions order by `input_file_name`()", "select sum(amount) over (order by `uuid`()) from transactions", "select * from global_temp.secret",
        "select * from transactions t where exists (select 1 from json.`/etc/hosts`)", "create view v as select 1", "select transform(array(1), x -> x) from transactions",
    ):
        assert "error" in q.run(bad), bad
    for good in (
        "select `count`(*) n, t.type, max(substr(desc, 1, 3)) from transactions t group by t.type having count(*) > 1 order by 1 desc",
        "select date, sum(amount) over (partition by type order by id rows between 2 preceding and current row) s, rank() over (order by amount desc) r from transactions",
        "with a as (with b as (select id, amount from transactions) select * from b where amount between 1 and 1e9) select avg(amount), stddev(amount) from a union all select 1, 2",
        "select a.id from transactions a left join transactions b on a.id = b.id + 1 where b.id is null intersect select id from transactions",
        "select coalesce(nullif(type, 'CR'), 'x'), case when amount > 5 then round(amount) else amount end, extract(year from to_date(date)), cast(id as string) from transactions",
        "select strftime('%Y', date(date)) y, amount / (((id - id))) z, upper(trim(desc)) || '!' from transactions where desc like '%upi%' and date > '1990-01-01'",
    ):
        found = q.run(good)
        assert not isinstance(found, dict), (good, found)
        found.collect()
    assert q.run("select max(amount / (((id - id)))) as z from transactions").first().z is None
    assert spark.table("transactions").count() == 3 and spark.table("secret").count() == 1
    q.close()
    assert "error" in q.run("select * from transactions")


def test_bridged_dialect():
    from ledgerloom.operators.ask import bridged

    assert bridged("select 'a like b / 0' from t where x LIKE 'A/%'") == "select 'a like b / 0' from t where x ILIKE 'A/%'"
    assert bridged("select sum(a)/count(*), a / (b - c), a/2 from t") == "select sum(a)/ nullif(count(*), 0), a / nullif((b - c), 0), a/ nullif(2, 0) from t"
    assert bridged("select strftime('%Y-%m', date) from t") == "select date_format(date, 'yyyy-MM') from t"


def test_a_batch_tried_again_counts_once(spark, tmp_path):
    from ledgerloom.operators import sinks

    rows = [(1, 1, "x"), (2, 1, "y")]
    spark.createDataFrame(rows, "doc_id long, page_no long, text string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("doc_id long, page_no long, text string").parquet(str(tmp_path / "in"))
    for place in ("one", "two"):  # a second run without the first one's progress stands for a batch that is tried again
        sinks.ingest_stream(stream(), lambda f: f.select("doc_id"), str(tmp_path / "out"), str(tmp_path / place)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_of_requests(spark, tmp_path):
    from ledgerloom.streaming.limits import limited_windows

    rows = [(f"2024-01-01 00:00:{s:02d}", 1) for s in range(0, 40, 3)] + [("2024-01-01 01:00:00", 2)]
    frame = spark.createDataFrame(rows, "t string, user_id long").selectExpr("cast(t as timestamp) as ts", "user_id")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = limited_windows(stream).writeStream.format("memory").queryName("limited").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.user_id for r in spark.sql("select * from limited").collect()} == {1}
