import random

from ledgerloom.operators import gst, joins

LEDGER = "account_id long, row_no long, date date, desc string, type string, amount_c long"


def test_range_match_is_the_nested_loop(spark):
    rng = random.Random(2)
    bank = [(rng.randint(1, 3), rng.choice([rng.randint(1, 300), rng.randint(1, 10_000_000)]), i) for i in range(1500)]
    invoices = [(f"i{i}", rng.randint(1, 3), rng.choice([0, 50, 99, 100, rng.randint(1, 10_000_000), rng.choice(bank)[1]])) for i in range(300)]
    left = spark.createDataFrame(invoices, "left_id string, account_id long, inv_c long")
    right = spark.createDataFrame(bank, "account_id long, bank_c long, bank_row long")
    got = {r.left_id: r.match.bank_row for r in joins.first_within_percent(left, right, "inv_c", "bank_c", ["account_id"], "bank_row").collect()}
    want = {}
    for key, account, total in invoices:
        for a, c, row in bank:
            if total > 0 and a == account and abs(c - total) <= max(total, 100) * 0.01:
                want[key] = row
                break
    assert got == want


def test_circular_window_counts_active_days(spark):
    rows = [(1, 0, "2024-01-01", "to x", "CR", 600_000)]
    rows += [(1, i, f"2024-02-{i:02d}", "other", "CR", 1) for i in range(1, 8)]
    rows += [(1, 20, "2024-02-07", "to x", "DR", 600_099), (1, 21, "2024-02-08", "to x", "DR", 600_000), (1, 22, "2024-02-07", "to x", "DR", 600_100)]
    df = spark.createDataFrame([(a, r, None, d, t, c) for a, r, _, d, t, c in rows], LEDGER)
    dates = spark.createDataFrame([(r, day) for _, r, day, *_ in rows], "row_no long, day string")
    df = df.drop("date").join(dates, "row_no").selectExpr("account_id", "row_no", "cast(day as date) as date", "desc", "type", "amount_c")
    assert [r.dr_row for r in joins.circular_flows(df).collect()] == [20]


def test_duplicates_need_alike_narrations(spark):
    rows = [(1, 1, None, "grocery store one", "DR", 500_00), (1, 2, None, "grocery store two", "DR", 500_20), (1, 3, None, "abcdef", "DR", 900_00), (1, 4, None, "uvwxyz", "DR", 900_00)]
    df = spark.createDataFrame(rows, LEDGER).selectExpr("account_id", "row_no", "date'2024-01-01' as date", "desc", "type", "amount_c")
    assert sorted(r.row_no for r in joins.duplicate_suspects(df).collect()) == [1, 2]


def test_slabs(spark):
    rows = [(0, 100), (2, 100), (3, 100), (8, 100), (9, 100), (15, 100), (23, 100), (40, 100), (5, 0)]
    df = spark.createDataFrame(rows, "tax long, taxable long").select(gst.slab(*[__import__("pyspark").sql.functions.col(c) for c in ("tax", "taxable")]).alias("s"))
    assert [r.s for r in df.collect()] == [0, 0, 5, 5, 12, 12, 18, 28, 18]


def test_set_off_never_crosses_central_and_state(spark):
    df = spark.createDataFrame([(100, 50, 50, 500, 0, 0), (0, 100, 100, 0, 300, 0), (100, 100, 100, 150, 20, 10)], "out_igst_c long, out_cgst_c long, out_sgst_c long, itc_igst_c long, itc_cgst_c long, itc_sgst_c long")
    got = [(r.net_igst_c, r.net_cgst_c, r.net_sgst_c, r.net_payable_c) for r in gst.set_off(df).collect()]
    assert got == [(0, 0, 0, 0), (0, 0, 100, 100), (0, 30, 90, 120)]


def brute_recon(statement, register):
    by_both, by_no, used, out = {}, {}, set(), []
    for row, inv, gstin, itc in register:
        by_both[inv.upper(), gstin.upper()] = (row, gstin, itc)
        by_no.setdefault(inv.upper(), (row, gstin, itc))
    for row, inv, gstin, itc, ok in statement:
        exact = by_both.get((inv.upper(), gstin.upper()))
        hit = exact or by_no.get(inv.upper())
        if not hit:
            out.append((row, None, "In GSTR-2B only", itc if ok else 0))
            continue
        used.add(hit[0])
        if not exact and hit[1] and gstin and hit[1].upper() != gstin.upper():
            out.append((row, hit[0], "GSTIN Mismatch", 0))
        elif abs(itc - hit[2]) <= max(itc, hit[2]) * 0.01 or abs(itc - hit[2]) <= 100:
            out.append((row, hit[0], "Matched", itc))
        else:
            out.append((row, hit[0], "Amount Mismatch", min(itc, hit[2])))
    return out + [(None, row, "In Purchase Register only", 0) for row, *_ in register if row not in used]


def test_reconciliation_is_the_loop(spark):
    rng = random.Random(6)
    name = lambda: rng.choice(["a", "A", "b", "c", "d", "e"]) + str(rng.randint(1, 9))
    statement = [(i, name(), rng.choice(["", "g1", "G2"]), rng.choice([10_000, 10_100, 10_101, 20_000]), rng.random() < 0.7) for i in range(120)]
    register = [(i, name(), rng.choice(["", "g1", "g2"]), rng.choice([10_000, 10_200, 20_000])) for i in range(90)]
    s = spark.createDataFrame(statement, "row_no long, invoice_no string, gstin string, itc_c long, itc_eligible boolean")
    r = spark.createDataFrame(register, "row_no long, invoice_no string, gstin string, itc_c long")
    order = lambda x: tuple(str(v) for v in x)
    got = [(x.s_row, x.r_row, x.status, x.claim_c) for x in gst.reconcile(s, r).collect()]
    assert sorted(got, key=order) == sorted(brute_recon(statement, register), key=order)
