"""Queries that SQL has no similarity for, against nested loops in plain Python over every row of the smallest tables."""

import os
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.operators import engine, joins, reports
from ledgerloom.plans import catalog
from ledgerloom.sources import fixtures

DATA = os.environ.get("TEST_SMALL_DIR", "/root/testdata/sf0.001")


def ratio(a, b):
    return SequenceMatcher(None, (a or "")[:30].lower(), (b or "")[:30].lower()).ratio()


def rupees(c):
    return round(c / 100)


def by_account(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.account_id].append(r)
    return out


def flows(rows):
    """All (credit, debit) of one account that are less than 1.00 and at most seven active days apart."""
    days = {d: k for k, d in enumerate(sorted({r.date for r in rows if r.date}))}
    dated = [r for r in rows if r.date]
    credits = [r for r in dated if r.type == "CR" and r.amount_c >= 500_000]
    debits = [r for r in dated if r.type == "DR"]
    return [(c, d) for c in credits for d in debits if 0 <= days[d.date] - days[c.date] <= 7 and abs(c.amount_c - d.amount_c) < 100]


def circular(rows):
    kept = [(c, d) for c, d in flows(rows) if ratio(c.desc, d.desc) > 0.45 or (c.amount_c >= 5_000_000 and c.amount_c % 500_000 == 0)]
    return len({(c.date, d.date, rupees(c.amount_c)) for c, d in kept})


def suspects(rows):
    """The rows of groups of one account, day, type and rounded amount in which two narrations are alike."""
    groups = defaultdict(list)
    for r in rows:
        groups[r.account_id, r.date, r.type, rupees(r.amount_c)].append(r)
    out = []
    for (_, date, *_), group in groups.items():
        if date and any(ratio(*sorted((a.desc or "", b.desc or ""), key=lambda t: t[:30].lower())) > 0.70 for a, b in combinations(group, 2)):
            out += group
    return out


@pytest.fixture(scope="module")
def rounded(spark):
    return classify.enriched(catalog._rounded(spark, DATA))


@pytest.fixture(scope="module")
def circulars(spark):
    return {a: circular(rows) for a, rows in by_account(catalog._rounded(spark, DATA).collect()).items()}


def test_circular_similar(spark):
    want = {
        (a, c.row_no, d.row_no): ratio(c.desc, d.desc) for a, rows in by_account(catalog._rounded(spark, DATA).collect()).items() for c, d in flows(rows) if ratio(c.desc, d.desc) > 0.45
    }
    got = {(r.account_id, r.cr_row, r.dr_row): r.similarity for r in catalog.circular_similar(spark, DATA).collect()}
    assert want and got == pytest.approx(want)


def test_flag_scores(rounded, circulars):
    flags = {r.account_id: r for r in reports.red_flags(rounded).collect()}
    want = {a: (n, min(n * 15 + flags[a].gambling * 10 + flags[a].penalties * 5, 100)) for a, n in circulars.items()}
    got = {r.account_id: (r.circular, r.flag_score) for r in reports.flag_scores(rounded).collect()}
    assert got == want
    assert len({n for n, _ in want.values()}) > 2


def test_flows_count_in_the_risk_section(spark, rounded, circulars, monkeypatch):
    flags = {r.account_id: r for r in reports.red_flags(rounded).collect()}
    want, moved = {}, 0
    for e in engine.engine(rounded).collect():
        a = e.account_id
        score = min(circulars[a] * 15 + flags[a].gambling * 10 + flags[a].penalties * 5, 100)
        both = max(e.risk_score, round(score / 2))
        moved += both > e.risk_score and circulars[a] > 0
        level = "High" if both >= 50 else "Medium" if both >= 20 else "Low"
        want[a] = (both, "High" if score >= 50 and level == "Low" else level)
    monkeypatch.setattr(catalog, "enriched", lambda s, d: rounded)
    got = {r.account_id: (r.combined_score, r.overall) for r in catalog.risk_section(spark, DATA).collect()}
    assert got == want
    assert moved


def test_duplicate_suspects(spark):
    """Dates and amounts are made coarse, so that an account's rows meet in groups."""
    rows = catalog._days(spark, DATA).withColumns({"date": F.trunc("date", "year"), "amount_c": F.col("amount_c") - F.col("amount_c") % 10_000_000})
    want, given = sorted(r.txn_id for r in suspects(rows.collect())), rows.count()
    assert sorted(r.txn_id for r in joins.duplicate_suspects(rows).select("txn_id").collect()) == want
    grouped = joins.same_day_groups(rows).count()
    assert 0 < len(want) < grouped < given


def test_audit_scores(spark):
    noisy = fixtures.noisy_ledger(spark, DATA)
    mismatched = Counter(r.account_id for r in noisy.join(catalog.audit_mismatches(spark, DATA), "txn_id", "left_semi").collect())
    rows = classify.enriched(noisy).select("account_id", "date", "desc", "type", "amount_c", "flow", "is_bounce", "is_emi").collect()
    doubled = Counter(r.account_id for r in suspects(rows))
    want = {}
    for a, own in by_account(rows).items():
        bounces = sum(r.flow == "DR" and r.is_bounce for r in own)
        emi = sum(r.amount_c for r in own if r.type == "DR" and r.is_emi)
        credit = sum(r.amount_c for r in own if r.flow == "CR")
        lost = min(mismatched[a] * 5, 30) + min(bounces * 10, 30) + min(doubled[a] * 3, 15)
        want[a] = (mismatched[a], bounces, doubled[a], emi, credit, max(100 - lost, 0), round(emi * 100.0 / credit, 1) if credit else 0.0)
    got = {r.account_id: (r.mismatches, r.bounces, r.duplicates, r.emi_c, r.total_cr_c, r.reconciliation_score, r.emi_to_income) for r in catalog.audit_scores(spark, DATA).collect()}
    assert got.keys() == want.keys()
    for a in want:
        assert got[a][:6] == want[a][:6]
        assert got[a][6] == pytest.approx(want[a][6], abs=0.1)
