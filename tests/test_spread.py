from ledgerloom.sources import fixtures

SMALL = "/root/testdata/sf0.001"


def test_a_large_ledger_is_dealt_into_parts_of_bounded_size(spark, monkeypatch):
    before = sorted(tuple(r) for r in fixtures.ledger(spark, SMALL).collect())
    monkeypatch.setattr(fixtures, "ROWS_A_TASK", 100, raising=False)
    after = fixtures.ledger(spark, SMALL)
    assert after.rdd.getNumPartitions() >= len(before) // 100
    assert sorted(tuple(r) for r in after.collect()) == before


def test_the_dashboard_reads_and_classifies_the_ledger_once(spark):
    from ledgerloom.plans import catalog

    assert catalog.dashboard_rows(spark, SMALL).inputFiles() == []
