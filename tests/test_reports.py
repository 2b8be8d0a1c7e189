from difflib import SequenceMatcher

from ledgerloom.functions import classify, rules
from ledgerloom.operators import reports
from ledgerloom.plans import catalog
from ledgerloom.sources import fixtures

#: account, date, narration, type, amount in paise
FLOWS = []
for k in range(4):
    FLOWS += [(1, f"2024-01-{2 * k + 1:02d}", f"transfer party {k}", "CR", 600_000 + k * 1_000), (1, f"2024-01-{2 * k + 2:02d}", f"transfer party {k}", "DR", 600_000 + k * 1_000)]
FLOWS += [(2, "2024-01-01", "abcdefgh", "CR", 5_000_000), (2, "2024-01-02", "zyxwvu", "DR", 5_000_000), (2, "2024-01-02", "zyxwvu", "DR", 5_000_000)]
FLOWS += [(3, "2024-01-01", "abcdefgh", "CR", 600_000), (3, "2024-01-02", "zyxwvu", "DR", 600_000), (3, "2024-01-03", "dream11", "DR", 100)]
FLOWS += [(4, "2024-01-01", "plain words", "DR", 700_000)]


def frame(spark, rows):
    given = [(a, i, i, d, text, t, c, 50_000_000) for i, (a, d, text, t, c) in enumerate(rows)]
    df = spark.createDataFrame(given, "account_id long, row_no long, txn_id long, date string, desc string, type string, amount_c long, balance_c long")
    return classify.enriched(df.selectExpr("account_id", "row_no", "txn_id", "cast(date as date) as date", "desc", "type", "amount_c", "balance_c"))


def brute_circular(rows, account):
    rows = [r for r in rows if r[0] == account]
    days, seen = sorted({r[1] for r in rows}), set()
    for _, d, text, t, c in rows:
        for _, d2, text2, t2, c2 in rows:
            near = 0 <= days.index(d2) - days.index(d) < 8
            if t == "CR" and t2 == "DR" and c >= 500_000 and near and abs(c - c2) < 100:
                if SequenceMatcher(None, text[:30], text2[:30]).ratio() > 0.45 or c >= 5_000_000 and c % 500_000 == 0:
                    seen.add((d, d2, round(c / 100)))
    return len(seen)


def test_circular_flows_score(spark, monkeypatch):
    monkeypatch.setattr(catalog, "enriched", lambda spark, d: frame(spark, FLOWS))
    got = {r.account_id: (r.circular, r.flag_score) for r in catalog.flag_scores(spark, "").collect()}
    assert got == {a: (n := brute_circular(FLOWS, a), 15 * n + 10 * (a == 3)) for a in (1, 2, 3, 4)}
    assert got[1] == (4, 60)
    assert {r.account_id: r.combined_score for r in catalog.risk_section(spark, "").collect()}[1] >= 30


def test_lenders_and_destinations(spark):
    rows = [(1, f"2024-01-{1 + i % 28:02d}", f"{word} x", "DR", 1_000 * (i + 1)) for i, word in enumerate(rules.EMI)]
    rows += [(1, "2024-02-01", "snapmint again", "CR", 9_000_000), (1, "2024-02-01", "atm withdrawal", "DR", 8_000_000), (1, "2024-02-01", "to own account", "DR", 8_000_000)]
    rows += [(2, "2024-02-01", f"{name} bill", "DR", 100 * (k + 1)) for k, name in enumerate(["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfer", "hotel", "india", "juliet", "kilos"])]
    df = frame(spark, rows)
    sums = {}
    for _, _, text, t, c in rows:
        word = next((w for w in rules.EMI if w in text), None)
        if t == "DR" and word:
            sums[word] = sums.get(word, 0) + c
    got = [(r.lender, r.total_c) for r in reports.lenders(df).where("account_id = 1").orderBy("rank").collect()]
    assert got == sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:8]
    found = reports.destinations(df).orderBy("account_id", "rank").collect()
    assert len([r for r in found if r.account_id == 1]) == 10 and max(r.total_c for r in found) < 8_000_000
    assert [(r.total_c, r.debits) for r in found if r.account_id == 2] == [(100 * k, 1) for k in range(11, 1, -1)]


def test_audit_score(spark):
    rows = [(1, "2024-01-01", "salary", "CR", 100_000), (1, "2024-01-02", "cheque bounce", "DR", 10_000), (1, "2024-01-02", "cheque bounce", "DR", 10_000), (1, "2024-01-05", "home loan", "DR", 33_333), (2, "2024-01-01", "x", "DR", 5)]
    got = {r.account_id: r for r in reports.audit_scores(frame(spark, rows)).collect()}
    assert (got[1].mismatches, got[1].bounces, got[1].duplicates, got[1].emi_to_income) == (2, 2, 2, 33.3)
    assert got[1].reconciliation_score == 100 - 10 - 20 - 6
    assert (got[2].reconciliation_score, got[2].emi_to_income) == (100, 0.0)


def test_latest_hundred(spark, monkeypatch):
    rows = spark.range(120).selectExpr("1L as account_id", "id as row_no", "id as txn_id")
    monkeypatch.setattr(fixtures, "ledger", lambda spark, d: rows)
    assert {r.txn_id for r in catalog.latest_hundred(spark, "").collect()} == set(range(20, 120))


def test_income_report_at_its_bounds(spark):
    rows = [
        (1, "CR", "salary", "acme", 100), (1, "CR", "salary", "acme", 50), (1, "CR", "salary", "globex", 7), (1, "CR", "salary", "", 3),
        (1, "CR", "business", "initech", 200_000_000), (1, "CR", "cash_deposit", "", 20_000_000), (1, "DR", "cash_deposit", "", 80_000_000),
        (2, "CR", "business", "", 199_999_999), (2, "CR", "cash_deposit", "", 19_999_999), (2, "CR", "refund", "acme", 5),
        (3, "DR", None, "acme", 9), (3, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "account_id long, type string, credit_class string, employer string, amount_c long")
    got = {r.account_id: r for r in reports.income_report(df).collect()}
    assert (got[1].salary_c, got[1].salary_credits, got[1].employers) == (160, 4, 2)
    assert (got[1].cash_deposit_c, got[1].large_cash_deposits, got[1].much_cash) == (100_000_000, 2, True)
    assert (got[1].gst_estimate_c, got[1].gst_threshold_crossed) == (36_000_000, True)
    assert (got[2].large_cash_deposits, got[2].much_cash, got[2].gst_threshold_crossed, got[2].employers) == (0, False, False, 0)
    assert (got[3].salary_c, got[3].business_c, got[3].employers, got[3].large_cash_deposits, got[3].much_cash) == (0, 0, 0, 0, False)
    assert reports.income_report(df.where("false")).count() == 0
    assert sorted((r.account_id, r.employer, r.total_c, r.credits) for r in reports.salary_employers(df).collect()) == [(1, "acme", 150, 2), (1, "globex", 7, 1)]
