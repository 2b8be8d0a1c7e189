"""DuckDB SQL that states each query's result anew, over the same tables."""

from __future__ import annotations

import re

from ledgerloom.functions import classify
from ledgerloom.functions import rules as R
from ledgerloom.operators import gst
from ledgerloom.sources.fixtures import NARRATIONS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def literal(words: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def anywhere(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def has(column: str, words: list[str]) -> str:
    """Words of up to five characters between non-alphanumerics, longer ones anywhere."""
    parts = []
    for w in words:
        if len(w.strip()) <= 5:
            parts.append(f"regexp_matches({column}, {quoted('(^|[^a-zA-Z0-9])' + re.escape(w.strip()) + '([^a-zA-Z0-9]|$)')})")
        else:
            parts.append(f"contains({column}, {quoted(w)})")
    return "(" + " OR ".join(parts) + ")"


def case(branches: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, v in branches) + f" ELSE {otherwise} END"


LED = f"""
led0 AS (SELECT o_custkey AS account_id, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS date, {literal(NARRATIONS)}[o_orderkey % {len(NARRATIONS)} + 1] AS "desc",
         CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'CR' ELSE 'DR' END AS type, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_c FROM orders),
led AS (SELECT *, row_number() OVER w AS row_no, CAST(50000000 + sum(CASE type WHEN 'CR' THEN amount_c ELSE -amount_c END) OVER w AS BIGINT) AS balance_c
        FROM led0 WINDOW w AS (PARTITION BY account_id ORDER BY date, txn_id ROWS UNBOUNDED PRECEDING))"""
NOISY = LED + """,
noisy AS (SELECT account_id, txn_id, date, "desc", row_no,
          CASE WHEN txn_id % 17 = 0 THEN (CASE type WHEN 'CR' THEN 'DR' ELSE 'CR' END) ELSE type END AS type,
          CASE WHEN txn_id % 19 = 0 THEN amount_c + 12345 ELSE amount_c END AS amount_c,
          CASE WHEN txn_id % 23 = 0 THEN NULL ELSE balance_c END AS balance_c FROM led)"""

_CLASS = case(
    [
        (anywhere("l", R.LOAN_SOURCES), "loan_disbursal"),
        (anywhere("l", R.SELF_PATTERNS), "self_transfer"),
        (anywhere("l", R.FAMILY_NAMES), "family_transfer"),
        (has("l", R.REVERSAL), "refund"),
        (has("l", R.REIMBURSEMENT), "reimbursement"),
        (has("l", R.NON_INCOME), "non_income"),
        (has("l", R.CASH_DEPOSIT), "cash_deposit"),
        (has("l", R.SALARY), "salary"),
        (has("l", R.FREELANCE) + " OR " + has("l", R.MARKETPLACE) + " OR " + has("l", R.BUSINESS), "business"),
        (has("l", R.DIVIDEND), "dividend"),
        (has("l", R.INTEREST), "interest"),
        (has("l", R.RENTAL), "rental"),
    ],
    "'needs_verification'",
)
_PARSER = (
    f"CASE WHEN starts_with(l, 'pci/') THEN {case([(anywhere('l', [k]), v) for k, v in classify.PCI_CATEGORY.items()], quoted('POS'))} "
    "WHEN starts_with(l, 'mb:') THEN (CASE WHEN contains(l, 'salary') THEN 'Salary' WHEN contains(l, 'sent to') THEN 'Family Transfer' "
    "WHEN contains(l, 'received from') THEN 'MB Transfer' ELSE 'Transfer' END) "
    f"WHEN {anywhere('l', R.LOAN_SOURCES)} THEN 'Loan Disbursal' WHEN {anywhere('l', R.FAMILY_NAMES)} THEN 'Family Transfer' "
    f"WHEN {anywhere('l', ['meesho', 'shiprocket', 'myntra des', 'reliance r', 'ekart'])} THEN 'Marketplace Income' "
    f"ELSE {case([(anywhere('l', v), k) for k, v in classify.PARSER_CATEGORY.items()], quoted('Other'))} END"
)
_MODE = case([(f"regexp_matches(l, {quoted(R.UPI_PATTERN)})", "UPI"), *[(anywhere("l", v), k) for k, v in R.MODES.items()]], "'Other'")
ENR = LED + f""",
e0 AS (SELECT *, lower("desc") AS l, strftime(date, '%Y-%m') AS month FROM led),
e1 AS (SELECT *, {has('l', R.CASH_DEPOSIT)} AS is_cdm, {anywhere('l', R.LOAN_SOURCES)} AS is_loan, {has('l', R.EMI)} AS is_emi, {has('l', R.BOUNCE)} AS is_bounce,
       {has('l', R.CASH)} AS is_cash, {_PARSER} AS cat0, {_MODE} AS mode, {_CLASS} AS klass FROM e0),
enr AS (SELECT *, CASE cat0 WHEN 'NEFT/RTGS' THEN (CASE type WHEN 'CR' THEN 'NEFT Received' ELSE 'NEFT Sent' END)
                            WHEN 'ATM/Cash' THEN (CASE type WHEN 'CR' THEN 'Cash Deposit' ELSE 'ATM Withdrawal' END) ELSE cat0 END AS parser_category,
        CASE WHEN amount_c <= 0 THEN NULL WHEN type = 'CR' OR is_cdm THEN 'CR' WHEN type = 'DR' THEN 'DR' END AS flow,
        CASE WHEN amount_c > 0 AND type = 'CR' THEN klass WHEN amount_c > 0 AND is_cdm THEN 'cash_deposit' END AS credit_class FROM e1)"""
_VPA = r"regexp_extract(l, '(?:upi|p2m)[/\-]([a-z][a-z0-9]{2,20})[@\.]', 1)"
_SPEND = case(
    [(has("l", v), k) for k, v in R.SPEND.items()] + [(f"vpa <> '' AND {anywhere('vpa', [w for w in v if len(w) > 4])}", k) for k, v in R.SPEND.items()],
    f"CASE WHEN lower(parser_category) NOT IN ({', '.join(quoted(w) for w in R.PAYMENT_WORDS)}) THEN parser_category ELSE 'Others' END",
)
SPENT = ENR + f""",
sp0 AS (SELECT *, {_VPA} AS vpa FROM enr WHERE type = 'DR' AND amount_c <> 0 AND NOT is_loan),
spent AS (SELECT *, {_SPEND} AS category FROM sp0)"""
#: The sender of each narration that names one, as a reader finds it.
_SENDERS = {
    "NEFT CR-0042-ACME WORKS PVT LTD/Salary April": "acme works pvt ltd",
    "Salary for march globex india": "for march globex india",
    "IMPS-1234-JOHN TRADERS-HDFC0001": "john traders",
    "Cash deposit at/BR01/CDM": "br01",
    "UPI/family member one/transfer": "family member one",
    "RTGS-9981-GLOBEX TRADING CO/supply": "globex trading co",
    "MB:Received from Jane Stores": "jane stores",
}
EMPLOYER = case([(f'"desc" = {quoted(k)}', v) for k, v in _SENDERS.items()], "''")
_KNOWN = sorted(classify.KNOWN_MERCHANTS, key=lambda m: (-len(m), m))
_STOP = "('nach', 'neft', 'imps', 'rtgs', 'debit', 'credit', 'transfer', 'payment', 'bank', 'from', 'to', 'upi', 'ref', 'no', 'txn')"
_WHO = f"""coalesce(known, nullif(vpa[1:25], ''), CASE WHEN length(emp) > 2 THEN emp[1:25] END,
          list_filter(regexp_split_to_array(l, '[\\s/\\-:]+'), lambda w: length(w) > 3 AND w NOT IN {_STOP} AND NOT regexp_full_match(w, '\\d+'))[1][1:20], 'other')"""
_NAMES = f"""{EMPLOYER} AS emp, {case([(f"contains(l, {quoted(m)})", m) for m in _KNOWN], "NULL")} AS known"""
MERCHANT = SPENT + f""",
m0 AS (SELECT *, {_NAMES} FROM spent),
merch AS (SELECT *, {_WHO} AS merchant FROM m0)"""

_T = "', '".join(R.TAXABLE)
MONTHS = ENR + f""",
mon AS (SELECT account_id, month, count(flow) AS flows, CAST(sum(CASE WHEN flow = 'CR' THEN amount_c ELSE 0 END) AS BIGINT) AS cr_c,
        CAST(sum(CASE WHEN flow = 'DR' THEN amount_c ELSE 0 END) AS BIGINT) AS dr_c,
        CAST(sum(CASE WHEN credit_class IN ('{_T}') THEN amount_c ELSE 0 END) AS BIGINT) AS real_c, min(balance_c) AS min_balance_c FROM enr GROUP BY ALL),
eod AS (SELECT account_id, date, arg_max(balance_c, row_no) AS eod_c FROM led WHERE balance_c IS NOT NULL GROUP BY ALL),
ends AS (SELECT account_id, strftime(date, '%Y-%m') AS month, arg_max(eod_c, date) AS month_end_c, CAST(sum(eod_c) AS BIGINT) AS eod_sum_c, count(*) AS days FROM eod GROUP BY ALL)"""
R0 = "CAST(floor({} + 0.5) AS BIGINT)"


def _sum(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN amount_c ELSE 0 END) AS BIGINT)"


_rate = R.INTEREST_RATE / 12
ANNUITY = (1 - (1 + _rate) ** -R.TENURE_MONTHS) / _rate
ENGINE = MONTHS + f""",
tot AS (SELECT account_id, count(*) AS txns, {_sum("credit_class = 'loan_disbursal'")} AS loan_c, count(*) FILTER (credit_class = 'loan_disbursal') AS loans,
        {_sum("credit_class = 'family_transfer'")} AS family_c, count(*) FILTER (credit_class = 'family_transfer') AS families, {_sum("credit_class = 'cash_deposit'")} AS cash_c,
        {_sum("credit_class = 'needs_verification'")} AS unver_c, {_sum("flow = 'DR' AND is_emi")} AS emi_c, count(*) FILTER (flow = 'DR' AND is_bounce) AS bounces,
        avg(CAST(balance_c AS DOUBLE)) AS ab0, sum(balance_c) AS bsum, count(balance_c) AS bn, min(balance_c) AS min_balance_c, max(balance_c) AS max_balance_c FROM enr GROUP BY ALL),
per AS (SELECT account_id, count(*) AS n_months, CAST(sum(cr_c) AS BIGINT) AS total_cr_c, CAST(sum(dr_c) AS BIGINT) AS total_dr_c, CAST(sum(real_c) AS BIGINT) AS real_c,
        max(real_c) AS top_c, sum(CAST(real_c AS DOUBLE) * real_c) AS sq, avg(CASE WHEN dr_c > 0 THEN dr_c END) AS mean_dr, count(*) FILTER (dr_c > 0) AS n_dr FROM mon WHERE flows > 0 GROUP BY ALL),
poor AS (SELECT account_id, count(*) FILTER (m.real_c <= CAST(p.real_c AS DOUBLE) / n_months * 0.1) AS poor_months, count(*) FILTER (n_dr >= 3 AND m.dr_c > mean_dr * 2.5) AS spikes
         FROM mon m JOIN per p USING (account_id) WHERE flows > 0 GROUP BY ALL),
neg AS (SELECT account_id, count(*) FILTER (min_balance_c < 0) AS negative_months FROM mon GROUP BY ALL),
day AS (SELECT account_id, count(*) FILTER (eod_c < 0) AS negative_days FROM eod GROUP BY ALL),
k0 AS (SELECT *, {R0.format('CAST(real_c AS DOUBLE) / n_months')} AS avg_real_c, {R0.format('CAST(total_cr_c AS DOUBLE) / n_months')} AS avg_credit_c,
       {R0.format('CAST(total_dr_c AS DOUBLE) / n_months')} AS avg_debit_c, {R0.format('CAST(emi_c AS DOUBLE) / n_months')} AS monthly_emi_c,
       {R0.format('CAST(bsum AS DOUBLE) / bn')} AS avg_balance_c
       FROM tot JOIN per USING (account_id) JOIN poor USING (account_id) JOIN neg USING (account_id) JOIN day USING (account_id)),
k1 AS (SELECT *, CASE WHEN avg_real_c > 1000 THEN avg_real_c ELSE avg_credit_c END AS base_c,
       CASE WHEN n_months > 3 AND real_c - top_c > 0 AND top_c > CAST(real_c - top_c AS DOUBLE) / (n_months - 1) * 1.5 THEN 1 ELSE 0 END AS trim FROM k0),
k2 AS (SELECT *, CASE WHEN base_c = 0 THEN 0.0 ELSE {R0.format('CAST(monthly_emi_c AS DOUBLE) / base_c * 1000')} / 10.0 END AS foir,
       greatest(0, {R0.format('base_c * 50.0 / 100')} - monthly_emi_c) AS remaining_emi_c,
       CAST(real_c - trim * top_c AS DOUBLE) / (n_months - trim) AS mean, (sq - trim * CAST(top_c AS DOUBLE) * top_c) / (n_months - trim) AS meansq,
       CASE WHEN (CASE WHEN real_c > 0 THEN real_c ELSE total_cr_c END) = 0 THEN 0.0 ELSE CAST(loan_c AS DOUBLE) / (CASE WHEN real_c > 0 THEN real_c ELSE total_cr_c END) * 100 END AS dep,
       greatest(0, avg_debit_c - monthly_emi_c) AS variable_c FROM k1),
k3 AS (SELECT *, CASE WHEN real_c <= 0 THEN 100.0 ELSE least(round(sqrt(greatest(meansq - mean * mean, 0.0)) / mean * 100, 1) + poor_months * 15, 100.0) END AS stability_cv,
       CASE WHEN foir <= 35 THEN 'Healthy' WHEN foir <= 50 THEN 'Moderate' ELSE 'High Risk' END AS foir_status, {R0.format(f'remaining_emi_c * {ANNUITY!r}::DOUBLE')} AS loan_eligible_c,
       CASE WHEN dep < 20 AND loans <= 1 THEN 'Low' WHEN dep >= 50 OR loans >= 5 THEN 'High' ELSE 'Medium' END AS loan_dependency,
       CASE WHEN negative_months = 0 AND foir <= 35 AND avg_balance_c >= base_c * 0.5 THEN 'Strong' WHEN negative_months <= 2 AND foir <= 50 THEN 'Moderate' ELSE 'Needs Improvement' END AS credit_indicator,
       base_c - monthly_emi_c - variable_c AS disposable_c FROM k2),
k4 AS (SELECT *, CASE WHEN real_c <= 0 THEN 'Volatile' WHEN stability_cv < 25 THEN 'Stable' WHEN stability_cv < 50 THEN 'Moderately Stable' ELSE 'Volatile' END AS income_stability,
       CASE WHEN base_c = 0 THEN 0.0 ELSE CAST(disposable_c AS DOUBLE) / base_c * 100 END AS savings_rate,
       list_filter([CASE WHEN loans >= 3 THEN 'FREQUENT_LOAN_DISBURSALS' END,
         CASE WHEN families >= 4 OR (total_cr_c > 0 AND CAST(family_c AS DOUBLE) / total_cr_c * 100 > 15) THEN 'HIGH_FAMILY_TRANSFERS' END,
         CASE WHEN cash_c >= 20000000 THEN 'HEAVY_CASH_DEPOSITS' END, CASE WHEN base_c > 0 AND avg_balance_c < base_c * 0.2 THEN 'LOW_AVERAGE_BALANCE' END,
         CASE WHEN bounces >= 1 THEN 'CHEQUE_BOUNCES' END, CASE WHEN negative_days >= 1 THEN 'NEGATIVE_BALANCE_DAYS' END, CASE WHEN spikes > 0 THEN 'SPENDING_SPIKE' END,
         CASE WHEN total_cr_c > 0 AND CAST(unver_c AS DOUBLE) / total_cr_c * 100 > 30 THEN 'LARGE_UNVERIFIED_CREDITS' END], lambda x: x IS NOT NULL) AS flags FROM k3),
k5 AS (SELECT *, CAST(least(100, coalesce(list_sum(list_transform(flags, lambda f: CASE WHEN f IN ('FREQUENT_LOAN_DISBURSALS', 'LOW_AVERAGE_BALANCE', 'CHEQUE_BOUNCES', 'NEGATIVE_BALANCE_DAYS') THEN 20 ELSE 10 END)), 0)) AS INTEGER) AS rs,
       avg_balance_c / (CASE WHEN avg_real_c = 0 THEN 100.0 ELSE CAST(avg_real_c AS DOUBLE) END) AS cover FROM k4),
kpi AS (SELECT *, coalesce(rs, 0) AS risk_score, CASE WHEN coalesce(rs, 0) >= 50 THEN 'High' WHEN coalesce(rs, 0) >= 20 THEN 'Medium' ELSE 'Low' END AS risk_level,
        greatest(0, least(100, 100 - (CASE income_stability WHEN 'Stable' THEN 0 WHEN 'Moderately Stable' THEN 10 ELSE 25 END)
        - (CASE WHEN cover >= 1 THEN 0 WHEN cover >= 0.5 THEN 5 WHEN cover >= 0.2 THEN 12 ELSE 20 END)
        - (CASE WHEN negative_days <= 0 THEN 0 WHEN negative_days <= 2 THEN 7 WHEN negative_days <= 5 THEN 11 ELSE 15 END)
        - (CASE WHEN foir <= 35 THEN 0 WHEN foir <= 40 THEN 6 WHEN foir <= 50 THEN 11 WHEN foir <= 60 THEN 16 ELSE 20 END)
        - (CASE loan_dependency WHEN 'Low' THEN 0 WHEN 'Medium' THEN 6 ELSE 12 END)
        - (CASE WHEN bounces <= 0 THEN 0 WHEN bounces <= 1 THEN 4 WHEN bounces <= 3 THEN 6 ELSE 8 END))) AS health_score FROM k5)"""

ROUNDED = LED + """,
rl AS (SELECT account_id, txn_id, date, "desc", type, row_no, balance_c, amount_c - amount_c % 2500000 + 500000 AS amount_c FROM led)"""
PAIRS = ROUNDED + """,
dy AS (SELECT *, dense_rank() OVER (PARTITION BY account_id ORDER BY date) AS day FROM rl),
pairs AS (SELECT c.account_id, c.row_no AS cr_row, d.row_no AS dr_row, c.amount_c AS cr_c, c.date AS credit_date, d.date AS debit_date FROM dy c JOIN dy d USING (account_id)
          WHERE c.type = 'CR' AND d.type = 'DR' AND c.amount_c >= 500000 AND d.day BETWEEN c.day AND c.day + 7 AND abs(c.amount_c - d.amount_c) < 100)"""

_PARTIES = literal(["Acme software pvt ltd", "Grand hotel", "City pharma", "Fast courier", "Export house usd", "Steel works", "Interest advisors", "Plain trader"])
INV = f"""
i0 AS (SELECT l_orderkey * 31 + l_linenumber * 7 + l_suppkey * 3 + l_partkey AS h, concat('INV-', l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS invoice_no,
       CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS n1, CAST(round(l_tax * 100) AS BIGINT) AS pct, s_nationkey, c_nationkey, l_suppkey, o_custkey
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
i1 AS (SELECT *, (n1 + 50) // 100 AS taxable_c, {_PARTIES}[h % 8 + 1] AS party,
       CASE h % 10 WHEN 0 THEN '' WHEN 1 THEN 'BAD123' ELSE lpad(CAST(1 + s_nationkey % 24 AS VARCHAR), 2, '0') || 'ABCDE' || lpad(CAST(l_suppkey % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gstin_raw FROM i0),
i2 AS (SELECT *, (taxable_c * pct + 50) // 100 AS tax_c, s_nationkey <> c_nationkey AS away FROM i1),
i3 AS (SELECT *, CASE WHEN away THEN tax_c ELSE 0 END AS igst_c, CASE WHEN away THEN 0 ELSE tax_c // 2 END AS cgst_c, CASE WHEN away THEN 0 ELSE tax_c - tax_c // 2 END AS sgst_c FROM i2),
inv AS (SELECT o_custkey AS account_id, h, invoice_no, party, gstin_raw, taxable_c, cgst_c, sgst_c, igst_c, tax_c AS itc_c, taxable_c + tax_c AS total_c,
        regexp_full_match(gstin_raw, '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]') AS gstin_valid, lower(party) AS p, igst_c > 0 AS interstate FROM i3),
invd AS (SELECT *, CASE WHEN gstin_valid THEN 'B2B' ELSE 'B2C' END AS supply_type,
         CASE WHEN gstin_valid THEN {case([(f"gstin_raw[1:2] = '{k}'", v) for k, v in gst.STATES.items()], "'Unknown'")} ELSE 'Unknown' END AS state,
         {case([(f"contains(p, {quoted(k)})", v) for k, v in gst.HSN.items()], "'9999'")} AS hsn_code,
         CASE WHEN taxable_c <= 0 THEN 18 ELSE (SELECT arg_min(s, (abs(s - floor(itc_c * 100 / taxable_c + 0.5)), s)) FROM (SELECT unnest([0, 5, 12, 18, 28]) AS s)) END AS gst_rate,
         CASE WHEN {anywhere('p', gst.EXPORT)} THEN 'export' WHEN {anywhere('p', gst.EXEMPT)} THEN 'exempt' ELSE 'taxable' END AS nature FROM inv)"""
RECON = INV + """,
st AS (SELECT invoice_no AS inv, gstin_raw AS gst, itc_c, h % 5 <> 0 AS ok FROM invd WHERE h % 11 <> 0),
rg AS (SELECT invoice_no AS inv, CASE WHEN h % 19 = 0 THEN '29' || gstin_raw[3:15] ELSE gstin_raw END AS gst, itc_c + CASE WHEN h % 7 = 0 THEN 5000 ELSE 0 END AS itc_c FROM invd WHERE h % 13 <> 0),
j AS (SELECT s.inv AS statement_no, r.inv AS register_no, s.itc_c AS a, r.itc_c AS b, s.ok,
      CASE WHEN r.inv IS NULL THEN 'In GSTR-2B only' WHEN r.gst <> s.gst AND r.gst <> '' AND s.gst <> '' THEN 'GSTIN Mismatch'
           WHEN abs(s.itc_c - r.itc_c) <= greatest(s.itc_c, r.itc_c) * 0.01::DOUBLE OR abs(s.itc_c - r.itc_c) <= 100 THEN 'Matched' ELSE 'Amount Mismatch' END AS status
      FROM st s LEFT JOIN rg r USING (inv)),
recon AS (SELECT statement_no, register_no, status, CASE status WHEN 'Matched' THEN 0 WHEN 'In GSTR-2B only' THEN a ELSE a - b END AS itc_diff_c,
          CASE WHEN status = 'Matched' THEN a WHEN status = 'Amount Mismatch' THEN least(a, b) WHEN status = 'In GSTR-2B only' AND ok THEN a ELSE 0 END AS claim_c FROM j
          UNION ALL SELECT NULL, inv, 'In Purchase Register only', -itc_c, 0 FROM rg WHERE inv NOT IN (SELECT inv FROM st))"""

_TAX = f"type = 'DR' AND amount_c > 0"
_C80 = f"({has('l', R.S80C)} AND NOT {has('l', R.S80C_EXCLUDED)})"
_D80 = has("l", R.S80D)
_RET = anywhere("l", ["ecs", "nach", "mandate", "si "])
_CARD = f"(type = 'DR' AND amount_c <> 0 AND {has('l', R.CARD_PAYMENT)})"
_KIND = (
    f"CASE WHEN {has('l', R.INTEREST)} THEN 'nil' WHEN {has('l', R.FOREIGN)} THEN 'export' WHEN {has('l', R.B2B_SELLERS)} OR {has('l', R.B2B_GATEWAYS)} THEN 'b2b' WHEN amount_c >= 10000 THEN 'b2c' END"
)
_N = "(CASE WHEN row_no = 1 THEN 50000000 ELSE lag(balance_c) OVER (PARTITION BY account_id ORDER BY row_no) END)"
VALID = NOISY + f""",
v0 AS (SELECT *, {_N} AS prev, CASE type WHEN 'CR' THEN amount_c ELSE -amount_c END AS sg FROM noisy),
v1 AS (SELECT *, CASE WHEN prev IS NULL OR balance_c IS NULL OR amount_c = 0 THEN 'verified' WHEN abs(prev + sg - balance_c) <= 50 THEN 'verified' WHEN abs(prev - sg - balance_c) <= 50 THEN 'swapped'
       WHEN row_no > 1 AND balance_c <> prev AND abs(abs(balance_c - prev) - amount_c) > 100 THEN 'amount_fixed' ELSE 'unverified' END AS status, NOT (prev IS NULL OR balance_c IS NULL OR amount_c = 0) AS checkable FROM v0)"""
_PRINT = "CASE txn_id % 12 WHEN 0 THEN date WHEN 11 THEN NULL ELSE date END"

SQL = {
    "ledger": f"WITH {LED} SELECT * FROM led",
    "credit_classes": f"WITH {ENR} SELECT txn_id, flow, credit_class FROM enr WHERE credit_class IS NOT NULL",
    "parser_categories": f"WITH {ENR} SELECT txn_id, parser_category, mode FROM enr",
    "spend_categories": f"WITH {SPENT} SELECT txn_id, category FROM spent",
    "merchants": f"WITH {MERCHANT} SELECT txn_id, merchant FROM merch",
    "monthly_summary": f"""WITH {MONTHS} SELECT account_id, month, real_c AS income_c, dr_c AS expenses_c, real_c - dr_c AS savings_c, coalesce(month_end_c, 0) AS closing_c, real_c >= dr_c AS surplus
        FROM mon LEFT JOIN ends USING (account_id, month) WHERE flows > 0""",
    "class_totals": f"WITH {ENR} SELECT account_id, credit_class, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS credits FROM enr WHERE credit_class IS NOT NULL GROUP BY ALL",
    "type_repair": f"""WITH {NOISY}, p AS (SELECT *, lag(balance_c) OVER (PARTITION BY account_id ORDER BY row_no) AS prev, greatest(100, (amount_c + 50) // 100) AS tol FROM noisy),
        f AS (SELECT *, CASE WHEN row_no = 1 THEN (CASE WHEN abs(balance_c - amount_c) <= tol OR balance_c >= amount_c THEN 'CR' WHEN balance_c + amount_c >= 0 THEN 'DR' END)
              WHEN abs(balance_c - prev - amount_c) <= tol THEN 'CR' WHEN abs(balance_c - prev + amount_c) <= tol THEN 'DR' END AS shown FROM p)
        SELECT txn_id, CASE WHEN txn_id % 13 = 0 THEN type ELSE coalesce(shown, type) END AS fixed_type, txn_id % 13 <> 0 AND coalesce(shown, type) <> type AS changed FROM f""",
    "deduplicated": f"""WITH {LED} SELECT txn_id, row_no * 2 AS row_no, CASE WHEN txn_id % 31 = 0 AND length("desc") > 9 THEN trim("desc") WHEN txn_id % 31 = 0 THEN "desc" || ' RBI mandate page 2'
        ELSE trim("desc") END AS "desc" FROM led""",
    "filled_balances": f"""WITH {NOISY}, g AS (SELECT *, count(balance_c) OVER (PARTITION BY account_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS g FROM noisy)
        SELECT txn_id, CAST(coalesce(max(balance_c) OVER (PARTITION BY account_id, g), 50000000) + sum(CASE WHEN balance_c IS NOT NULL THEN 0 WHEN type = 'CR' THEN amount_c ELSE -amount_c END)
        OVER (PARTITION BY account_id, g ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS filled_c FROM g""",
    "validated_rows": f"""WITH {VALID} SELECT txn_id, status, CASE status WHEN 'swapped' THEN (CASE type WHEN 'CR' THEN 'DR' ELSE 'CR' END) WHEN 'amount_fixed' THEN (CASE WHEN balance_c > prev THEN 'CR' ELSE 'DR' END)
        ELSE type END AS new_type, CASE status WHEN 'amount_fixed' THEN abs(balance_c - prev) ELSE amount_c END AS new_amount_c FROM v1""",
    "validation_summary": f"""WITH {VALID}, s AS (SELECT account_id, count(*) AS total, count(*) FILTER (checkable) AS checkable, count(*) FILTER (status IN ('swapped', 'amount_fixed')) AS auto_fixed,
        count(*) FILTER (status = 'unverified') AS unverified FROM v1 GROUP BY ALL)
        SELECT *, (total - unverified) * 100.0::DOUBLE / total AS score, CASE WHEN unverified = 0 OR (total - unverified) * 100.0::DOUBLE / total >= 95 THEN 'green'
        WHEN (total - unverified) * 100.0::DOUBLE / total >= 85 THEN 'yellow' ELSE 'red' END AS badge_color FROM s""",
    "verification": f"""WITH {NOISY}, o AS (SELECT *, coalesce(abs(lag(balance_c) OVER (PARTITION BY account_id ORDER BY row_no) + CASE type WHEN 'CR' THEN amount_c ELSE -amount_c END - balance_c) > 100, FALSE) AS off FROM noisy),
        s AS (SELECT account_id, count(*) AS total, count(*) - count(balance_c) AS missing_balance, count(*) FILTER (amount_c = 0) AS missing_amount, count(*) FILTER (off) AS continuity_errors,
        arg_min(balance_c, row_no) AS o1, {_sum("type = 'CR'")} AS credits_c, {_sum("type = 'DR'")} AS debits_c, max(row_no) AS last FROM o GROUP BY ALL),
        b AS (SELECT s.*, f.balance_c AS opening_c, z.balance_c AS closing_c FROM s LEFT JOIN noisy f ON f.account_id = s.account_id AND f.row_no = 1 LEFT JOIN noisy z ON z.account_id = s.account_id AND z.row_no = s.last),
        p AS (SELECT *, CASE WHEN total > 1 THEN (total - 1 - continuity_errors) * 100.0::DOUBLE / (total - 1) ELSE 100.0 END AS continuity_pct,
        (total - greatest(missing_balance, missing_amount)) * 100.0::DOUBLE / total AS fields_pct FROM b)
        SELECT account_id, total, missing_balance, missing_amount, continuity_errors, opening_c, closing_c, credits_c, debits_c, continuity_pct, fields_pct, (continuity_pct + fields_pct) / 2 AS overall FROM p""",
    "audit_mismatches": f"""WITH {NOISY}, o AS (SELECT *, lag(balance_c) OVER w AS pb, lag(date) OVER w AS pd FROM noisy WINDOW w AS (PARTITION BY account_id ORDER BY date, row_no)),
        e AS (SELECT *, pb + CASE type WHEN 'CR' THEN amount_c ELSE -amount_c END AS expected_c FROM o)
        SELECT txn_id, expected_c, abs(expected_c - balance_c) AS diff_c FROM e WHERE amount_c <> 0 AND date - pd <= 1 AND abs(expected_c - balance_c) > 200""",
    "end_of_day": f"WITH {MONTHS} SELECT * FROM eod",
    "balance_kpis": f"WITH {MONTHS} SELECT * FROM ends",
    "engine_kpis": f"""WITH {ENGINE} SELECT account_id, txns, n_months, real_c, total_cr_c, total_dr_c, avg_real_c, avg_credit_c, avg_debit_c, monthly_emi_c, avg_balance_c, min_balance_c, max_balance_c,
        negative_months, negative_days, base_c, foir, foir_status, remaining_emi_c, loan_eligible_c, stability_cv, income_stability, loan_dependency, credit_indicator, disposable_c, savings_rate,
        risk_score, risk_level, health_score FROM kpi""",
    "risk_flags": f"WITH {ENGINE} SELECT account_id, unnest(flags) AS flag FROM kpi",
    "income_sources": f"""WITH {LED}, c AS (SELECT *, {EMPLOYER} AS emp FROM led WHERE type = 'CR' AND amount_c <> 0),
        s AS (SELECT account_id, CASE WHEN emp <> '' THEN emp ELSE coalesce(list_filter(regexp_split_to_array(lower("desc"), '\\s+'), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\\d+'))[1], 'unknown') END AS sender, amount_c FROM c),
        a AS (SELECT account_id, sender, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS credits FROM s GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY total_c DESC, sender) AS INTEGER) AS rank FROM a QUALIFY rank <= 10""",
    "salary_employers": f"""WITH {ENR}, w AS (SELECT *, {EMPLOYER} AS employer FROM enr WHERE type = 'CR' AND credit_class = 'salary')
        SELECT account_id, employer, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS credits FROM w WHERE employer <> '' GROUP BY ALL""",
    "income_report": f"""WITH {ENR}, w AS (SELECT *, {EMPLOYER} AS emp FROM enr), s AS (SELECT account_id,
        {', '.join(_sum(f"credit_class = '{k}'") + f" AS {k}_c" for k in ('salary', 'business', 'interest', 'dividend', 'rental', 'cash_deposit'))},
        {', '.join(f"count(*) FILTER (credit_class = '{k}') AS {k}_credits" for k in ('salary', 'business', 'cash_deposit'))},
        count(DISTINCT emp) FILTER (type = 'CR' AND credit_class = 'salary' AND emp <> '') AS employers,
        count(*) FILTER (credit_class = 'cash_deposit' AND amount_c >= 20000000) AS large_cash_deposits FROM w GROUP BY ALL)
        SELECT *, cash_deposit_c >= 100000000 AS much_cash, {R0.format('business_c * 0.18::DOUBLE')} AS gst_estimate_c, business_c >= 200000000 AS gst_threshold_crossed FROM s""",
    "expense_categories": f"WITH {SPENT} SELECT account_id, category, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS debits FROM spent GROUP BY ALL",
    "top_merchants": f"""WITH {MERCHANT}, a AS (SELECT account_id, merchant, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS debits FROM merch WHERE merchant NOT IN ('unknown', 'other') GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY total_c DESC, merchant) AS INTEGER) AS rank FROM a QUALIFY rank <= 15""",
    "cash_flow": f"""WITH {ENR}, m AS (SELECT account_id, month, {_sum("type = 'CR'")} AS cr_c, {_sum("type <> 'CR'")} AS dr_c, sum(balance_c) AS s, count(balance_c) AS n, arg_max(balance_c, (date, row_no)) AS eom FROM enr GROUP BY ALL),
        w AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month DESC) AS recent, row_number() OVER (PARTITION BY account_id ORDER BY month) AS pos, count(*) OVER (PARTITION BY account_id) AS ends,
              avg(cr_c) OVER (PARTITION BY account_id) AS mean_cr FROM m),
        a AS (SELECT account_id, CAST(sum(s) FILTER (recent <= 3) AS DOUBLE) / sum(n) FILTER (recent <= 3) AS abb_3m, CAST(sum(s) FILTER (recent <= 6) AS DOUBLE) / sum(n) FILTER (recent <= 6) AS abb_6m,
              CAST(sum(s) FILTER (recent <= 12) AS DOUBLE) / sum(n) FILTER (recent <= 12) AS abb_12m, CAST(sum(s) AS DOUBLE) / sum(n) AS abb_overall, count(*) FILTER (cr_c >= dr_c) AS surplus_months,
              count(*) FILTER (cr_c < dr_c) AS deficit_months, CAST(sum(cr_c - dr_c) AS DOUBLE) / count(*) AS avg_net, count(*) FILTER (cr_c > mean_cr * 1.25) AS high_months,
              count(*) FILTER (cr_c > 0 AND cr_c < mean_cr * 0.75) AS low_months, max(ends) AS ends, coalesce(CAST(sum(eom) FILTER (pos <= ends // 2) AS DOUBLE) / count(*) FILTER (pos <= ends // 2), 0) AS early,
              coalesce(CAST(sum(eom) FILTER (pos > ends // 2) AS DOUBLE) / count(*) FILTER (pos > ends // 2), 0) AS late FROM w GROUP BY ALL)
        SELECT account_id, abb_3m, abb_6m, abb_12m, abb_overall, surplus_months, deficit_months, avg_net, high_months, low_months, CASE WHEN ends < 2 THEN 'Insufficient data' WHEN ends < 4 THEN 'Stable'
               WHEN late > early * 1.1::DOUBLE THEN 'Improving' WHEN late < early * 0.9::DOUBLE THEN 'Declining' ELSE 'Stable' END AS trend FROM a""",
    "compliance": f"""WITH {ENR}, c AS (SELECT account_id, count(*) FILTER (amount_c >= 20000000) AS high_value, count(*) FILTER (is_cash) AS cash, count(*) FILTER (amount_c >= 18000000 AND amount_c < 20000000) AS structured FROM enr GROUP BY ALL),
        d AS (SELECT account_id, date, {_sum("is_cash AND (is_cdm OR type = 'CR')")} AS cash_c, {_sum("type = 'CR'")} AS cr_c FROM enr GROUP BY ALL),
        p AS (SELECT account_id, count(*) FILTER (cash_c > 5000000) AS daily_breaches, CAST(sum(cash_c) AS BIGINT) AS annual_cash_c, count(*) FILTER (cr_c >= 50000000) AS str_days FROM d GROUP BY ALL)
        SELECT *, annual_cash_c >= 100000000 AS form_61a FROM c JOIN p USING (account_id)""",
    "tax_return": f"""WITH {ENR}, a AS (SELECT account_id, least({_sum(f"{_TAX} AND {_C80}")}, 15000000) AS s80c_c, least({_sum(f"{_TAX} AND NOT {_C80} AND {_D80}")}, 2500000) AS s80d_c,
        {_sum(f"{_TAX} AND NOT {_C80} AND NOT {_D80} AND {has('l', R.TDS)}")} AS tds_c, count(*) FILTER (type = 'CR' AND amount_c >= 10000000) AS large_credits,
        {_sum("credit_class = 'business'")} AS business_c, {_sum("credit_class = 'rental'")} AS rental_c, {_sum("credit_class = 'salary'")} AS salary_c FROM enr GROUP BY ALL)
        SELECT *, CASE WHEN business_c > 0 THEN 'ITR-3' WHEN rental_c > 0 THEN 'ITR-2' WHEN salary_c > 0 THEN 'ITR-1' ELSE 'verify' END AS form FROM a""",
    "obligations": f"""WITH {ENR} SELECT account_id, count(*) FILTER (type = 'DR' AND amount_c <> 0 AND is_emi) AS emis, {_sum("type = 'DR' AND is_emi")} AS emi_c, count(*) FILTER (is_bounce AND NOT {_RET}) AS bounces,
        count(*) FILTER (is_bounce AND {_RET}) AS ecs_returns, count(*) FILTER ({_CARD}) AS card_payments, {_sum(_CARD)} AS card_c FROM enr GROUP BY ALL""",
    "emi_months": f"""WITH {ENR}, a AS (SELECT account_id, month, {_sum("is_emi")} AS emi_c, count(*) FILTER ({_CARD}) AS cards FROM enr WHERE type = 'DR' AND amount_c <> 0 GROUP BY ALL)
        SELECT *, CASE WHEN cards > 1 THEN 'Multiple' WHEN cards = 1 THEN 'Single' END AS card_pattern FROM a WHERE emi_c > 0 OR cards > 0""",
    "supplies": f"""WITH {ENR}, s AS (SELECT account_id, month, {_KIND} AS kind, amount_c FROM enr WHERE type = 'CR' AND credit_class IN ('business', 'dividend', 'interest', 'rental') AND NOT {has('l', R.SALARY)})
        SELECT account_id, month, kind, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS credits FROM s WHERE kind IS NOT NULL GROUP BY ALL""",
    "payment_modes": f"""WITH {ENR}, a AS (SELECT account_id, mode, count(*) AS txns, {_sum("type = 'CR'")} AS cr_c, {_sum("type <> 'CR'")} AS dr_c FROM enr GROUP BY ALL)
        SELECT *, txns * 100.0::DOUBLE / CAST(sum(txns) OVER (PARTITION BY account_id) AS BIGINT) AS share FROM a""",
    "red_flags": f"""WITH {ENR} SELECT account_id, count(*) FILTER ({has('l', R.GAMBLING)}) AS gambling, {_sum(has('l', R.GAMBLING))} AS gambling_c, count(*) FILTER ({has('l', R.PENALTY)}) AS penalties,
        {_sum(has('l', R.PENALTY))} AS penalty_c FROM enr GROUP BY ALL""",
    "circular_pairs": f"WITH {PAIRS} SELECT account_id, cr_row, dr_row, cr_c FROM pairs",
    "circular_round_lots": f"WITH {PAIRS} SELECT DISTINCT account_id, credit_date, debit_date, round_even(CAST(cr_c AS DOUBLE) / 100, 0) AS amount FROM pairs WHERE cr_c >= 5000000 AND cr_c % 500000 = 0",
    "same_day_groups": f"""WITH {ROUNDED}, g AS (SELECT txn_id, count(*) OVER (PARTITION BY account_id, date_trunc('month', date), type, round_even(CAST(amount_c AS DOUBLE) / 100, 0)) AS alike FROM rl)
        SELECT * FROM g WHERE alike > 1""",
    "search_page": f"""WITH {ENR} SELECT txn_id, "desc" FROM enr WHERE contains(l, 'upi') OR contains(lower(parser_category), 'upi') ORDER BY account_id, row_no LIMIT 100 OFFSET 100""",
    "latest": f"WITH {LED} SELECT account_id, txn_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY row_no DESC) AS INTEGER) AS rank FROM led QUALIFY rank <= 5",
    "sql_summary": f"""WITH {NOISY} SELECT count(*) AS txns, round(sum(CASE WHEN type = 'CR' THEN amount_c / 100.0 ELSE 0 END)::DOUBLE) AS credits, round(sum(CASE WHEN type = 'DR' THEN amount_c / 100.0 ELSE 0 END)::DOUBLE) AS debits,
        CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, min(coalesce(balance_c, 0)) / 100.0::DOUBLE AS least, max(coalesce(balance_c, 0)) / 100.0::DOUBLE AS most FROM noisy""",
    "sql_anomalies": f"WITH {NOISY} SELECT count(*) FILTER (type IS NULL OR type = '') AS missing_type, count(*) FILTER (amount_c = 0) AS zero_amount, count(*) FILTER (balance_c < 0) AS negative_balance FROM noisy",
    "accounts_rollup": f"""WITH {ENR} SELECT account_id, count(*) AS txns, {_sum("flow = 'CR'")} AS cr_c, {_sum("flow = 'DR'")} AS dr_c FROM enr GROUP BY ROLLUP (account_id)""",
    "row_errors": f"""WITH {NOISY}, t AS (SELECT txn_id, CASE WHEN txn_id % 29 <> 0 THEN date END AS date, CASE WHEN txn_id % 31 = 0 THEN 0 WHEN txn_id % 37 <> 0 THEN amount_c END AS a, balance_c,
        CASE WHEN txn_id % 41 = 0 THEN 'XX' WHEN txn_id % 43 <> 0 THEN type END AS t FROM noisy), p AS (SELECT txn_id, concat_ws(',', CASE WHEN date IS NULL THEN 'missing date' END,
        CASE WHEN coalesce(a, 0) = 0 THEN 'missing amount' END, CASE WHEN balance_c IS NULL THEN 'missing balance' END, CASE WHEN t IS NULL OR t NOT IN ('CR', 'DR') THEN 'invalid type: ' || coalesce(t, 'None') END) AS problems FROM t)
        SELECT * FROM p WHERE problems <> ''""",
    "dates_parsed": f"WITH {LED} SELECT txn_id, CASE WHEN txn_id % 12 = 11 THEN NULL ELSE CAST(date + INTERVAL 120 MONTH AS DATE) END AS parsed FROM led",
    "amounts_parsed": f"WITH {LED} SELECT txn_id, CASE txn_id % 6 WHEN 5 THEN 0 WHEN 3 THEN amount_c - amount_c % 100 ELSE amount_c END AS parsed_c FROM led",
    "rate_limits": """WITH c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS recent FROM events)
        SELECT event_id, recent, recent > 3 AS limited FROM c""",
    "invoices": f"WITH {INV} SELECT invoice_no, gstin_valid, supply_type, state, hsn_code, gst_rate, interstate, nature, itc_c, total_c FROM invd",
    "gstr1_hsn": f"""WITH {INV} SELECT hsn_code, CAST(sum(total_c) AS BIGINT) AS total_c, CAST(sum(taxable_c) AS BIGINT) AS taxable_c, CAST(sum(cgst_c) AS BIGINT) AS cgst_c, CAST(sum(sgst_c) AS BIGINT) AS sgst_c,
        CAST(sum(igst_c) AS BIGINT) AS igst_c, count(*) AS invoices FROM invd GROUP BY ALL""",
    "gstr1_summary": f"""WITH {INV} SELECT count(*) AS invoices, CAST(sum(total_c) AS BIGINT) AS declared_c, CAST(sum(total_c) FILTER (gstin_valid) AS BIGINT) AS b2b_c, CAST(sum(total_c) FILTER (NOT gstin_valid) AS BIGINT) AS b2c_c,
        count(*) FILTER (gstin_valid) AS b2b, count(*) FILTER (NOT gstin_valid AND total_c > 25000000 AND interstate) AS b2c_large, count(*) FILTER (gstin_raw <> '' AND NOT gstin_valid) AS gstin_invalid,
        CAST(sum(itc_c) AS BIGINT) AS tax_c FROM invd""",
    "gstr1_b2c_large": f"WITH {INV} SELECT invoice_no, total_c * 4 AS total_c FROM invd WHERE NOT gstin_valid AND total_c * 4 > 25000000 AND interstate",
    "gstr3b_nature": f"""WITH {INV} SELECT nature, CAST(sum(taxable_c) AS BIGINT) AS taxable_c, CAST(sum(igst_c) AS BIGINT) AS igst_c, CAST(sum(cgst_c) AS BIGINT) AS cgst_c, CAST(sum(sgst_c) AS BIGINT) AS sgst_c,
        count(*) AS invoices FROM invd GROUP BY ALL""",
    "gstr3b_states": f"WITH {INV} SELECT state, CAST(sum(taxable_c) AS BIGINT) AS taxable_c, CAST(sum(igst_c) AS BIGINT) AS igst_c, count(*) AS invoices FROM invd WHERE interstate GROUP BY ALL",
    "gstr3b_credit": f"""WITH {INV} SELECT gstin_valid AS eligible, CAST(sum(igst_c) AS BIGINT) AS igst_c, CAST(sum(cgst_c) AS BIGINT) AS cgst_c, CAST(sum(sgst_c) AS BIGINT) AS sgst_c,
        CAST(sum(taxable_c) AS BIGINT) AS taxable_c, count(*) AS purchases FROM invd GROUP BY ALL""",
    "gstr3b_set_off": f"""WITH {INV}, a AS (SELECT account_id, h % 3 = 0 AND nature <> 'exempt' AS sold, h % 3 <> 0 AND gstin_valid AS bought, igst_c, cgst_c, sgst_c FROM invd),
        t AS (SELECT account_id, CAST(coalesce(sum(igst_c) FILTER (sold), 0) AS BIGINT) AS out_igst_c, CAST(coalesce(sum(cgst_c) FILTER (sold), 0) AS BIGINT) AS out_cgst_c, CAST(coalesce(sum(sgst_c) FILTER (sold), 0) AS BIGINT) AS out_sgst_c,
        CAST(coalesce(sum(igst_c) FILTER (bought), 0) AS BIGINT) AS itc_igst_c, CAST(coalesce(sum(cgst_c) FILTER (bought), 0) AS BIGINT) AS itc_cgst_c, CAST(coalesce(sum(sgst_c) FILTER (bought), 0) AS BIGINT) AS itc_sgst_c FROM a GROUP BY ALL),
        u AS (SELECT *, least(greatest(itc_igst_c - out_igst_c, 0), out_cgst_c) AS igst_for_cgst_c FROM t),
        w AS (SELECT *, least(greatest(itc_igst_c - out_igst_c, 0) - igst_for_cgst_c, out_sgst_c) AS igst_for_sgst_c FROM u),
        n AS (SELECT *, greatest(0, out_igst_c - itc_igst_c) AS net_igst_c, greatest(0, out_cgst_c - igst_for_cgst_c - itc_cgst_c) AS net_cgst_c, greatest(0, out_sgst_c - igst_for_sgst_c - itc_sgst_c) AS net_sgst_c FROM w)
        SELECT *, net_igst_c + net_cgst_c + net_sgst_c AS net_payable_c FROM n""",
    "gstr2b_rows": f"WITH {RECON} SELECT * FROM recon",
    "gstr2b_summary": f"WITH {RECON} SELECT status, count(*) AS invoices, CAST(sum(claim_c) AS BIGINT) AS claim_c, CAST(sum(abs(itc_diff_c)) AS BIGINT) AS diff_c FROM recon GROUP BY ALL",
    "bank_matches": f"""WITH {INV}, {LED}, m AS (SELECT i.invoice_no, l.row_no, l.amount_c FROM invd i JOIN led l USING (account_id) WHERE l.type = 'CR' AND l.amount_c > 0
        AND abs(l.amount_c - i.total_c) <= greatest(i.total_c, 100) * 0.01::DOUBLE) SELECT invoice_no, min(row_no) AS bank_row, arg_min(amount_c, row_no) AS bank_c FROM m GROUP BY ALL""",
    "consolidation": f"""WITH {ENR}, b AS (SELECT account_id, {_sum("type = 'CR' AND parser_category = 'Salary'")} AS salary_c, {_sum("type = 'CR' AND parser_category = 'Interest'")} AS interest_c,
        {_sum("type = 'CR' AND parser_category IN ('Freelance Income', 'Marketplace Income')")} AS business_c, {_sum("type = 'DR'")} AS debits_c, {_sum("type = 'DR' AND parser_category = 'EMI/Loan Repayment'")} AS emi_c,
        {_sum("type = 'DR' AND parser_category IN ('UPI', 'NEFT Sent', 'Transfer')")} AS operating_c, {_sum("type = 'DR' AND " + anywhere('l', ['advance tax', 'self assessment', 'income tax', 'tds']))} AS adv_c,
        count(*) FILTER (type = 'CR' AND amount_c >= 20000000) AS large, arg_max(balance_c, row_no) AS closing_c FROM enr GROUP BY ALL),
        c AS (SELECT c_custkey AS account_id, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer),
        j AS (SELECT b.*, a.bal, b.account_id % 3 <> 0 AS form, b.account_id % 4 <> 0 AS ais, b.account_id AS k FROM b JOIN c a USING (account_id)),
        s AS (SELECT *, CASE WHEN form THEN greatest(0, bal) ELSE 0 END AS declared, CASE WHEN form AND k % 2 = 0 THEN 100 ELSE 0 END AS stds, CASE WHEN form THEN k % 100 * 100 ELSE 0 END AS tds,
              CASE WHEN NOT ais OR k % 5 = 0 THEN 0 ELSE abs(bal) END AS a_sal, CASE WHEN ais THEN k % 7 * 10000 ELSE 0 END AS a_int, CASE WHEN ais THEN k % 6 * 1000 ELSE 0 END AS a_div,
              CASE WHEN ais THEN k % 8 * 5000000 ELSE 0 END AS a_gst, CASE WHEN ais THEN k % 9 * 1000 ELSE 0 END AS a_inv FROM j),
        r AS (SELECT *, CASE WHEN a_sal <> 0 THEN a_sal WHEN declared <> 0 THEN declared ELSE salary_c END AS income_salary_c, CASE WHEN a_int <> 0 THEN a_int ELSE interest_c END AS income_interest_c,
              CASE WHEN a_gst <> 0 THEN a_gst ELSE business_c END AS income_business_c, NOT ais AND large > 0 AS i3, ais AND a_gst > 0 AND abs(a_gst - business_c) > 5000000 AS i4 FROM s),
        t AS (SELECT *, income_salary_c + income_interest_c + income_business_c + a_div AS income_c FROM r)
        SELECT account_id, income_salary_c, income_interest_c, income_business_c, income_c, tds + adv_c AS tax_credit_c, greatest(0, income_business_c - operating_c) AS net_profit_c, income_c - debits_c AS surplus_c,
        closing_c + a_inv - emi_c * 36 AS net_worth_c,
        concat_ws(',', CASE WHEN declared > 0 AND salary_c > 0 AND abs(declared - salary_c) > 100000 THEN 'salary_mismatch' END, CASE WHEN a_int > 0 AND interest_c > 0 AND abs(a_int - interest_c) > 50000 THEN 'interest_mismatch' END) AS gaps,
        concat_ws(',', CASE WHEN stds > 0 AND salary_c = 0 THEN 'salary_not_in_bank' END, CASE WHEN a_int > 0 AND interest_c = 0 THEN 'interest_not_in_bank' END, CASE WHEN i3 THEN 'high_value_no_ais' END,
        CASE WHEN i4 THEN 'gst_mismatch' END) AS discrepancies,
        CASE WHEN NOT form AND a_sal + a_int + a_div <= 0 THEN 'incomplete' WHEN i3 OR i4 THEN 'review_needed' WHEN form THEN 'ready' ELSE 'partial' END AS filing_readiness FROM t""",
    "guarded_export": f"""WITH {LED}, c AS (SELECT txn_id, ['=', '+', '-', '@', '', 'a'][txn_id % 6 + 1] || "desc" AS cell FROM led) SELECT txn_id, CASE WHEN cell[1:1] IN ('=', '+', '-', '@') THEN '''' || cell ELSE cell END AS cell FROM c""",
}

_PAPER = """
cu AS (SELECT c_custkey AS doc_id, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS c, c_custkey * 10 + 5 AS k FROM customer),
sh AS (SELECT *, printf('%d.%02d', c // 100, c % 100) AS ca, printf('%d.%02d', k // 100, k % 100) AS ka FROM cu)"""
_INFO = _PAPER + """,
info AS (SELECT doc_id, 1 AS line_no, 'other_income' AS section, 'Opening line ' || ka AS description, k AS amount_c, 0 AS modified_c, '' AS date FROM sh
  UNION ALL SELECT doc_id, 3, 'salary', 'Employer paid ' || ca || ' ' || ka || ' 01-04-2024', c, k, '01-04-2024' FROM sh
  UNION ALL SELECT doc_id, 5, 'interest', 'Branch one ' || ka, k, 0, '' FROM sh UNION ALL SELECT doc_id, 6, 'interest', 'Branch two ' || ka, k, 0, '' FROM sh
  UNION ALL SELECT doc_id, 7, 'dividend', 'Dividend of shares ' || ca, c, 0, '' FROM sh UNION ALL SELECT doc_id, 8, 'gst_turnover', 'GST turnover ' || ca, c, 0, '' FROM sh
  UNION ALL SELECT doc_id, 10, 'rent', 'Rent received ' || ka, k, 0, '' FROM sh)"""
_CREDIT = _PAPER + """,
cred AS (SELECT doc_id, 3 AS line_no, 'A' AS part, 'ABCD12345E' AS tan, '192' AS section, c AS paid_c, k AS deducted_c, k AS deposited_c, '' AS date FROM cu
  UNION ALL SELECT doc_id, 4, 'A', 'WXYZ54321K', CASE WHEN contains(printf('%d.%02d', k // 100, k % 100), '192') THEN '192' ELSE '194J' END, k, k, 0, '' FROM cu
  UNION ALL SELECT doc_id, 8, 'B', '', '', c, k, 0, '' FROM cu
  UNION ALL SELECT doc_id, 10, 'C', '', '', c, k, 0, '' FROM cu UNION ALL SELECT doc_id, 12, 'D', '', '', k, 0, 0, '05-06-2024' FROM cu UNION ALL SELECT doc_id, 14, 'E', '', '', c, 0, 0, '' FROM cu)"""
_BANK = "['hdfc', 'icici', 'axis', 'canara', 'saraswat', '{}', 'sbi', 'pnb'][account_id % 8 + 1]"
SQL |= {
    "statement_routes": f"WITH {LED} SELECT DISTINCT account_id AS doc_id, {_BANK.format('kotak')} AS bank FROM led",
    "statement_headers": f"""WITH {LED} SELECT DISTINCT account_id AS doc_id, lpad(CAST(account_id AS VARCHAR), 10, '0') AS account_number, 'Current' AS account_type, DATE '2005-04-01' AS start_date,
        DATE '2006-03-31' AS end_date FROM led""",
    "statement_transactions": f"""WITH {LED}, b AS (SELECT *, {_BANK.format('kotak')} AS bank FROM led) SELECT account_id AS doc_id, CAST(row_no AS INTEGER) AS row_no, CAST(date + INTERVAL 120 MONTH AS DATE) AS date,
        trim("desc") || CASE WHEN bank IN ('hdfc', 'icici', 'canara') THEN ' note ' || row_no ELSE '' END AS "desc",
        CASE WHEN bank = 'icici' AND contains(lower("desc"), 'int.pd:') THEN 'CR' WHEN bank = 'sbi' AND contains(lower("desc"), 'cash deposit') THEN 'CR' ELSE type END AS type, amount_c, balance_c + 100000000000 AS balance_c, bank FROM b""",
    "information_entries": f"WITH {_INFO} SELECT * FROM info",
    "information_summary": f"WITH {_INFO}, s AS (SELECT doc_id, " + ", ".join(
        f"CAST(coalesce(sum(amount_c) FILTER (section = '{x}'), 0) AS BIGINT) AS {x}_c" for x in ("salary", "interest", "dividend", "securities", "mutual_fund", "foreign", "gst_turnover", "rent", "other_income", "tds_tcs")
    ) + " FROM info GROUP BY ALL) SELECT *, salary_c + interest_c + dividend_c + rent_c AS income_c FROM s",
    "tax_credit_entries": f"WITH {_CREDIT} SELECT * FROM cred",
    "tax_credit_summary": f"""WITH {_CREDIT} SELECT doc_id, CAST(sum(paid_c) FILTER (part = 'A') AS BIGINT) AS declared_c, CAST(sum(deducted_c) FILTER (part = 'A') AS BIGINT) AS tds_c,
        CAST(sum(deposited_c) FILTER (part = 'A') AS BIGINT) AS deposited_c, CAST(sum(deducted_c) FILTER (part = 'A' AND section = '192') AS BIGINT) AS salary_tds_c,
        CAST(sum(deducted_c) FILTER (part = 'C') AS BIGINT) AS tcs_c, CAST(sum(paid_c) FILTER (part = 'D') AS BIGINT) AS refund_c, CAST(sum(paid_c) FILTER (part = 'E') AS BIGINT) AS reported_c FROM cred GROUP BY ALL""",
}

_LIFTED = """SELECT account_id AS doc_id, {no} AS row_no, CAST(date + INTERVAL 120 MONTH AS DATE) AS date, {words} AS "desc", type, amount_c, balance_c + 100000000000 AS balance_c FROM led"""
SQL |= {
    "table_columns": f"""WITH {LED} SELECT DISTINCT account_id AS doc_id, 2::BIGINT AS header_no, [0, 2, 0][account_id % 4 + 1] AS at_date, [1, 1, 4][account_id % 4 + 1] AS at_description, [2, -1, 3][account_id % 4 + 1] AS at_debit,
        [3, -1, 2][account_id % 4 + 1] AS at_credit, [4, 3, 5][account_id % 4 + 1] AS at_balance, [-1, 4, -1][account_id % 4 + 1] AS at_amount, [-1, -1, 1][account_id % 4 + 1] AS at_reference FROM led WHERE account_id % 4 < 3""",
    "table_transactions": f"""WITH {LED} {_LIFTED.format(no='row_no', words="""trim("desc") || CASE WHEN account_id % 4 = 0 AND row_no % 5 = 0 THEN ' overflow' WHEN account_id % 4 = 3 THEN ' long enough' ELSE '' END""")}""",
    "online_transactions": f"WITH {LED} {_LIFTED.format(no='CAST(row_no AS INTEGER)', words='trim(\"desc\")')}",
    "merged_cell_transactions": f"WITH {LED} {_LIFTED.format(no='CAST(row_no AS INTEGER)', words='trim(\"desc\") || \' text\'')}",
    "recognised_rows": f"""WITH {LED} SELECT account_id AS doc_id, row_no // 20 AS page_no, concat_ws(' ', strftime(date + INTERVAL 120 MONTH, '%d-%m-%Y'), 'word', printf('%d.%02d', amount_c // 100, amount_c % 100),
        printf('%d.%02d', (balance_c + 100000000000) // 100, (balance_c + 100000000000) % 100)) AS line FROM led""",
    "recognised_columns": f"WITH {LED} SELECT DISTINCT account_id AS doc_id, row_no // 20 AS page_no, 900::BIGINT AS balance_left, 700::BIGINT AS amount_left FROM led",
    "amounts_filled": f"""WITH {LED}, a AS (SELECT account_id, txn_id, row_no, CASE WHEN txn_id % 6 <> 0 THEN amount_c END AS a, CASE WHEN txn_id % 6 <> 0 THEN type END AS t, CASE WHEN txn_id % 7 <> 0 THEN balance_c END AS b FROM led),
        p AS (SELECT *, b - last_value(b IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM a)
        SELECT txn_id, CASE WHEN a IS NULL AND d < 0 THEN 'DR' WHEN a IS NULL AND d > 0 THEN 'CR' ELSE t END AS type, coalesce(a, abs(d)) AS amount_c FROM p""",
    "word_cells": f"""WITH {LED} SELECT account_id AS doc_id, row_number() OVER (PARTITION BY account_id ORDER BY row_no) AS row_no,
        [strftime(date + INTERVAL 120 MONTH, '%d-%m-%Y'), 'two words', printf('%d.%02d', amount_c // 100, amount_c % 100)] AS cells FROM led""",
    "newest_first_filled": f"""WITH {LED}, a AS (SELECT account_id, txn_id, row_no, CASE WHEN txn_id % 6 <> 0 THEN amount_c END AS a, CASE WHEN txn_id % 6 <> 0 THEN type END AS t, CASE WHEN txn_id % 7 <> 0 THEN balance_c END AS b,
        first_value(date) OVER w < last_value(date) OVER w AS turned FROM led WINDOW w AS (PARTITION BY account_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        p AS (SELECT *, b - last_value(b IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY CASE WHEN turned THEN row_no ELSE -row_no END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM a)
        SELECT txn_id, CASE WHEN a IS NULL AND d < 0 THEN 'DR' WHEN a IS NULL AND d > 0 THEN 'CR' ELSE t END AS type, coalesce(a, abs(d)) AS amount_c FROM p""",
    "running_continuity": f"""WITH RECURSIVE {NOISY}, f AS (SELECT account_id, 0::BIGINT AS row_no, 50000000::BIGINT AS run, FALSE AS off, NULL::BIGINT AS computed_c, NULL::BIGINT AS printed_c FROM (SELECT DISTINCT account_id FROM noisy)
        UNION ALL SELECT n.account_id, n.row_no, CASE WHEN abs(f.run + s.s - n.balance_c) > 1 THEN n.balance_c ELSE f.run + s.s END, coalesce(abs(f.run + s.s - n.balance_c) > 1, FALSE), f.run + s.s, n.balance_c
        FROM f JOIN noisy n ON n.account_id = f.account_id AND n.row_no = f.row_no + 1, LATERAL (SELECT CASE n.type WHEN 'CR' THEN n.amount_c ELSE -n.amount_c END AS s) s)
        SELECT account_id AS doc_id, row_no, computed_c, printed_c FROM f WHERE off""",
    "loan_report": f"""WITH {ENGINE} SELECT account_id, avg_real_c, monthly_emi_c, loan_eligible_c, remaining_emi_c, CASE WHEN monthly_emi_c > 0 THEN CAST(avg_real_c AS DOUBLE) / monthly_emi_c END AS dscr, base_c = avg_real_c AS by_real_income FROM kpi""",
    "consistency": f"""WITH {ENGINE} SELECT account_id, concat_ws(',', CASE WHEN foir > 200 THEN 'foir' END, CASE WHEN dep > 100 THEN 'loan_dependency' END) AS failed FROM kpi""",
    "risk_section": f"""WITH {ENGINE}, r AS (SELECT account_id, least(count(*) FILTER ({has('l', R.GAMBLING)}) * 10 + count(*) FILTER ({has('l', R.PENALTY)}) * 5, 100) AS fs FROM enr GROUP BY ALL),
        c AS (SELECT *, CAST(greatest(risk_score, round_even(fs / 2, 0)) AS INTEGER) AS combined_score FROM kpi JOIN r USING (account_id))
        SELECT account_id, combined_score, CASE WHEN combined_score >= 50 THEN 'High' WHEN combined_score >= 20 THEN 'Medium' WHEN fs >= 50 THEN 'High' ELSE 'Low' END AS overall,
        trim(upper(risk_level) || ' (' || risk_score || '/100) ' || array_to_string(flags[1 : CASE risk_level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 0 END], '; ')) AS explanation FROM c""",
    "return_estimates": f"""WITH {ENR}, s AS (SELECT account_id, {_sum("type = 'CR'")} AS cr_c, {_sum("type = 'DR' AND " + anywhere('l', ['gst', 'tax invoice', 'bill']))} AS gst_c FROM enr GROUP BY ALL),
        v AS (SELECT *, {R0.format('cr_c / 1.18::DOUBLE')} AS taxable_c FROM s)
        SELECT account_id, taxable_c, {R0.format('taxable_c * 0.09::DOUBLE')} AS cgst_c, {R0.format('taxable_c * 0.09::DOUBLE')} AS sgst_c, {R0.format('gst_c * 0.18::DOUBLE / 1.18::DOUBLE')} AS credit_c FROM v""",
}

SQL |= {
    "invoices_cleaned": f"""WITH {INV}, dt AS (SELECT concat('INV-', l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey) AS invoice_no, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT invoice_no, CASE WHEN year(d) BETWEEN 2000 AND 2035 THEN d END AS date, party, gstin_raw, CASE WHEN h % 4 = 1 THEN {R0.format('total_c / 1.18::DOUBLE')} ELSE taxable_c END AS taxable_c, cgst_c, sgst_c, igst_c,
        total_c, TRUE AS itc_eligible FROM inv JOIN dt USING (invoice_no)""",
    "opening_inferred": f"""WITH {NOISY}, f AS (SELECT * FROM noisy WHERE balance_c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY row_no) = 1),
        o AS (SELECT account_id, CASE type WHEN 'CR' THEN balance_c - amount_c ELSE balance_c + amount_c END AS opening_c FROM f) SELECT * FROM o WHERE opening_c >= 0""",
    "table_openings": "SELECT c_custkey AS doc_id, CASE WHEN c_acctbal = 0 THEN 100 ELSE abs(CAST(round(c_acctbal * 100) AS BIGINT)) END AS opening_c FROM customer",
    "taxpayers": "SELECT c_custkey AS doc_id, 'ABCDE' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F' AS pan, 'JANE DOE' AS name, '1 Main Road' AS address, '2024-25' AS year FROM customer",
}


_HIT = "contains(l, '{0}') OR contains(CAST(date AS VARCHAR), '{0}') OR contains(lower(parser_category), '{0}')"
SQL |= {
    "search_last_page": f"""WITH {ENR}, f AS (SELECT txn_id, row_number() OVER (ORDER BY account_id, row_no) AS n, count(*) OVER () AS c FROM enr WHERE {_HIT.format('acme')})
        SELECT txn_id FROM f WHERE n > (c - 1) // 100 * 100""",
    "search_totals": f"""WITH {ENR}, t AS (SELECT count(*) AS found, count(*) FILTER (amount_c <> 0) AS amounts, {_sum("type = 'DR'")} AS debit_c, {_sum("type <> 'DR'")} AS credit_c FROM enr WHERE {_HIT.format('food')})
        SELECT *, debit_c + credit_c AS total_c, CAST(greatest(1, (found + 99) // 100) AS INTEGER) AS pages FROM t""",
    "latest_by_date": f"WITH {LED} SELECT account_id, txn_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY date DESC, row_no DESC) AS INTEGER) AS rank FROM led QUALIFY rank <= 100",
    "first_high_values": f"WITH {ENR} SELECT account_id, txn_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY row_no) AS INTEGER) AS rank FROM enr WHERE amount_c >= 20000000 QUALIFY rank <= 10",
    "ranked_modes": f"""WITH {ENR}, a AS (SELECT account_id, mode, sum(amount_c) AS v FROM enr GROUP BY ALL)
        SELECT account_id, mode, CAST(row_number() OVER (PARTITION BY account_id ORDER BY v DESC, mode) AS INTEGER) AS rank FROM a""",
    "ranked_categories": f"""WITH {SPENT}, a AS (SELECT account_id, category, sum(amount_c) AS v FROM spent GROUP BY ALL)
        SELECT account_id, category, CAST(row_number() OVER (PARTITION BY account_id ORDER BY v DESC, category) AS INTEGER) AS rank FROM a""",
    "negative_days": f"WITH {LED} SELECT account_id, date, arg_max(balance_c, row_no) AS eod_c FROM led GROUP BY ALL HAVING eod_c < 0",
    "flag_severities": f"""WITH {ENGINE}, f AS (SELECT account_id, unnest(flags) AS flag FROM kpi) SELECT *, CASE WHEN flag IN ('FREQUENT_LOAN_DISBURSALS', 'LOW_AVERAGE_BALANCE', 'CHEQUE_BOUNCES', 'NEGATIVE_BALANCE_DAYS')
        THEN 'High' ELSE 'Medium' END AS severity FROM f""",
    "health_grades": f"WITH {ENGINE} SELECT account_id, health_score, CASE WHEN health_score >= 80 THEN 'Excellent' WHEN health_score >= 65 THEN 'Good' WHEN health_score >= 45 THEN 'Average' ELSE 'Poor' END AS health_grade FROM kpi",
    "compliance_narratives": f"""WITH {ENGINE}, c AS (SELECT account_id, {_sum("is_cash AND (is_cdm OR type = 'CR')")} AS cash FROM enr GROUP BY ALL)
        SELECT account_id, CASE risk_level WHEN 'Low' THEN 'LOW compliance risk (' || risk_score || '/100). No major triggers. Cash total Rs' || format('{{:,}}', CAST(round_even(cash / 100, 0) AS BIGINT)) || ' within Rs10L limit.'
        WHEN 'Medium' THEN 'MEDIUM compliance risk (' || risk_score || '/100). Triggers: ' || array_to_string(flags[1:2], '; ') || '. Enhanced due diligence recommended.'
        ELSE 'HIGH compliance risk (' || risk_score || '/100). Triggers: ' || array_to_string(flags[1:3], '; ') || '. Immediate review required before sanction.' END AS narrative FROM kpi JOIN c USING (account_id)""",
    "latest_hundred": f"WITH {LED} SELECT account_id, txn_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY row_no DESC) AS INTEGER) AS rank FROM led QUALIFY rank <= 100",
    "lenders": f"""WITH {ENR}, d AS (SELECT account_id, amount_c, {case([(has('l', [w]), w) for w in R.EMI if len(w) > 4], 'NULL')} AS lender FROM enr WHERE type = 'DR' AND amount_c <> 0 AND is_emi),
        a AS (SELECT account_id, lender, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS debits FROM d WHERE lender IS NOT NULL GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY total_c DESC, lender) AS INTEGER) AS rank FROM a QUALIFY rank <= 8""",
    "destinations": f"""WITH {ENR}, x AS (SELECT *, {_VPA} AS vpa, {_NAMES} FROM enr WHERE type = 'DR' AND amount_c <> 0 AND NOT {anywhere('l', ['atm', 'cash', 'self', 'own account'])}),
        a AS (SELECT account_id, {_WHO} AS destination, CAST(sum(amount_c) AS BIGINT) AS total_c, count(*) AS debits FROM x GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY total_c DESC, destination) AS INTEGER) AS rank FROM a QUALIFY rank <= 10""",
    "dashboard_totals": f"""WITH {ENR} SELECT count(*) AS txns, count(DISTINCT account_id) AS accounts, {_sum("flow = 'CR'")} AS cr_c, {_sum("flow = 'DR'")} AS dr_c,
        {_sum("credit_class IN ('salary', 'business', 'interest', 'dividend', 'rental')")} AS real_c, {_sum("credit_class = 'loan_disbursal'")} AS loans_c, {_sum("credit_class = 'family_transfer'")} AS family_c FROM enr""",
    "credit_position": f"""WITH {RECON}, cst AS (SELECT invoice_no AS statement_no, itc_c AS s_itc FROM invd), t AS (SELECT count(statement_no) AS statement_rows, count(*) FILTER (status = 'Matched') AS matched,
        count(*) FILTER (status = 'GSTIN Mismatch') AS gstin_mismatches, CAST(coalesce(sum(s_itc), 0) AS BIGINT) AS statement_itc_c, CAST(coalesce(sum(claim_c) FILTER (status = 'Matched'), 0) AS BIGINT) AS matched_itc_c,
        CAST(coalesce(sum(abs(itc_diff_c)) FILTER (status = 'Amount Mismatch'), 0) AS BIGINT) AS mismatch_loss_c, CAST(coalesce(sum(s_itc) FILTER (status = 'GSTIN Mismatch'), 0) AS BIGINT) AS blocked_c,
        CAST(coalesce(sum(claim_c) FILTER (status = 'In GSTR-2B only'), 0) AS BIGINT) AS only_statement_c, CAST(coalesce(sum(-itc_diff_c) FILTER (status = 'In Purchase Register only'), 0) AS BIGINT) AS only_register_c
        FROM recon LEFT JOIN cst USING (statement_no)), g AS (SELECT CAST(sum(itc_c + CASE WHEN h % 7 = 0 THEN 5000 ELSE 0 END) AS BIGINT) AS register_itc_c FROM invd WHERE h % 13 <> 0),
        u AS (SELECT *, matched_itc_c + only_statement_c AS claimable_c, mismatch_loss_c + blocked_c + only_register_c AS at_risk_c, round(matched * 100.0::DOUBLE / greatest(statement_rows, 1), 1) AS match_rate FROM t, g),
        v AS (SELECT *, CASE WHEN at_risk_c = 0 AND gstin_mismatches = 0 THEN 'Low' WHEN at_risk_c * 10 < statement_itc_c THEN 'Medium' ELSE 'High' END AS risk_level FROM u) SELECT *, risk_level = 'Low' AS filing_ready FROM v""",
    "monthly_return": SQL["gstr3b_set_off"].replace("WITH ", f"WITH {LED}, ", 1).rsplit("SELECT *, net_igst_c", 1)[0] + """,
        cnt AS (SELECT account_id, count(*) FILTER (h % 3 = 0) AS sales, count(*) FILTER (h % 3 <> 0 AND gstin_valid) AS purchases FROM invd GROUP BY ALL),
        bk AS (SELECT account_id, CAST(coalesce(sum(amount_c) FILTER (type = 'CR'), 0) AS BIGINT) AS bank_cr_c, CAST(coalesce(sum(amount_c) FILTER (type = 'DR'), 0) AS BIGINT) AS bank_dr_c,
        string_agg(DISTINCT strftime(date, '%Y-%m'), ',' ORDER BY strftime(date, '%Y-%m')) AS months FROM led GROUP BY ALL)
        SELECT account_id, coalesce(sales, 0) AS sales, coalesce(purchases, 0) AS purchases, coalesce(out_igst_c + out_cgst_c + out_sgst_c, 0) AS output_tax_c, coalesce(itc_igst_c + itc_cgst_c + itc_sgst_c, 0) AS itc_c,
        coalesce(net_igst_c + net_cgst_c + net_sgst_c, 0) AS net_payable_c, coalesce(bank_cr_c, 0) AS bank_cr_c, coalesce(bank_dr_c, 0) AS bank_dr_c, coalesce(months, '') AS months
        FROM n JOIN cnt USING (account_id) FULL JOIN bk USING (account_id)""",
    "bank_gap": "WITH " + SQL["bank_matches"].split("WITH ", 1)[1].rsplit(" SELECT invoice_no, min", 1)[0] + """, d AS (SELECT count(*) AS i, CAST(sum(total_c) AS BIGINT) AS declared_c FROM invd),
        b AS (SELECT CAST(sum(amount_c) FILTER (type = 'CR') AS BIGINT) AS bank_c FROM led), k AS (SELECT count(DISTINCT invoice_no) AS matched FROM m)
        SELECT declared_c, bank_c, bank_c - declared_c AS gap_c, i - matched AS unmatched FROM d, b, k""",
    "sql_bridged": f"""WITH {LED} SELECT strftime(date, '%Y-%m') AS month, count(*) AS txns, round(sum(amount_c / 100.0::DOUBLE)) AS total, CAST(NULL AS DOUBLE) AS share FROM led
        WHERE lower("desc") LIKE 'upi/%' OR lower("desc") LIKE '%salary%' GROUP BY ALL""",
}

_UP = LED + """,
u0 AS (SELECT account_id * 10 + 1 AS upload_id, date, "desc", type, amount_c, balance_c FROM led
       UNION ALL SELECT account_id * 10 + 2, date, "desc", type, amount_c, balance_c FROM led WHERE account_id % 3 = 0
       UNION ALL SELECT account_id * 10 + 3, date, "desc", type, amount_c + CASE WHEN row_no = 1 THEN 1 ELSE 0 END, balance_c FROM led WHERE account_id % 7 = 0),
uh AS (SELECT upload_id, type, amount_c, md5('=' || date || '|=' || "desc" || '|=' || type || '|=' || amount_c || '|=' || balance_c) AS h FROM u0),
up AS (SELECT upload_id, h[1:2] AS part, md5(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM uh GROUP BY ALL),
ud AS (SELECT upload_id, md5(string_agg(h, '' ORDER BY part)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM up GROUP BY ALL)"""
_TOGETHER = LED.replace("led AS (", "each_led AS (", 1) + """,
led AS (SELECT CAST(account_id AS VARCHAR) AS account_id, txn_id, date, "desc", type, amount_c, row_no, balance_c FROM each_led
        UNION ALL SELECT 'together ' || (account_id % 50), txn_id, date, "desc", type, amount_c, row_number() OVER (PARTITION BY account_id % 50 ORDER BY account_id, row_no), balance_c FROM each_led)"""
SQL |= {
    "bundled_transactions": SQL["statement_transactions"],
    "strategy_transactions": f"""WITH {LED}, k AS (SELECT *, account_id % 4 AS kind FROM led) {_LIFTED.format(no='row_no', words="CASE WHEN kind = 2 THEN 'Ref ' ELSE '' END || trim(\"desc\")").replace("FROM led", "").replace("AS balance_c", "AS balance_c,")}
        ['table', 'relaxed', 'words', 'lines'][kind + 1] AS way FROM k""",
    "remembered_strategies": f"""WITH {LED} SELECT ['table', 'relaxed', 'words', 'lines'][account_id % 4 + 1] AS way, count(DISTINCT account_id) AS documents, count(*) AS rows FROM led
        WHERE (account_id // 4) % 2 = 1 GROUP BY ALL""",
    "footer_transactions": f"WITH {LED} {_LIFTED.format(no='row_no', words='trim(\"desc\")')}",
    "serials_missing": f"WITH {LED}, m AS (SELECT account_id, max(row_no) FILTER (row_no % 7 <> 0) AS last FROM led GROUP BY ALL) SELECT account_id AS doc_id, row_no AS serial FROM led JOIN m USING (account_id) WHERE row_no % 7 = 0 AND row_no < last",
    "rate_limits_streamed": SQL["rate_limits"],
    "distinct_uploads": f"WITH {_UP} SELECT *, upload_id = min(upload_id) OVER (PARTITION BY digest) AS counted FROM ud",
    "counted_once": f"""WITH {_UP}, f AS (SELECT digest, min(upload_id) AS upload_id FROM ud GROUP BY ALL)
        SELECT digest, CAST(coalesce(sum(amount_c) FILTER (type = 'CR'), 0) AS BIGINT) AS cr_c, CAST(coalesce(sum(amount_c) FILTER (type = 'DR'), 0) AS BIGINT) AS dr_c FROM f JOIN uh USING (upload_id) GROUP BY ALL""",
    "several_statements": SQL["engine_kpis"].replace(LED, _TOGETHER),
}

_REPORTS = {
    "engine": ("engine_kpis", "total_cr_c"), "monthly_summary": ("monthly_summary", "income_c"), "income": ("income_sources", None), "expense": ("expense_categories", "total_c"),
    "merchants": ("top_merchants", "total_c"), "cashflow": ("cash_flow", None), "compliance": ("compliance", None), "itr": ("tax_return", None), "obligations": ("obligations", None),
    "emi_months": ("emi_months", None), "lenders": ("lenders", "total_c"), "destinations": ("destinations", "total_c"), "gstr1": ("supplies", None), "payment_modes": ("payment_modes", None),
    "balance_kpis": ("balance_kpis", "month_end_c"), "negative_days": ("negative_days", None),
}
_CUSTOMER = "c0 AS (SELECT c_custkey AS doc_id, CAST(abs(round(c_acctbal * 100)) AS BIGINT) + 1 AS a, c_custkey * 10 + 5 AS k FROM customer)"
_NOISY_LED = NOISY.replace("led AS (", "clean AS (", 1).replace("FROM led)", "FROM clean)") + ", led AS (SELECT * FROM noisy)"
SQL |= {
    "dashboard_rows": " UNION ALL ".join(
        f"SELECT '{report}' AS report, count(*) AS rows, {f'CAST(coalesce(sum({column}), 0) AS BIGINT)' if column else 'CAST(NULL AS BIGINT)'} AS total_c FROM ({SQL[name]})" for report, (name, column) in _REPORTS.items()
    ) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{r}', count(DISTINCT o_custkey), NULL FROM orders" for r in ("audit", "red_flags")),
    "tax_credit_tables": f"""WITH {_CUSTOMER}, t(table_no, row_no, part, kind, reported_by, tan, section, p, d, e, date) AS (VALUES
        (0, 1, 'A', 'total', 'Acme salary office', 'ABCD12345E', '192', 'a', 'k', 'k', ''), (0, 2, 'A', 'payment', 'Acme salary office', 'ABCD12345E', '192', 'k', 'k', '', '05-06-2024'),
        (0, 3, 'A', 'payment', 'Acme salary office', 'ABCD12345E', '192', 'k', '', '', '05-07-2024'), (0, 4, 'A', 'total', 'Globex professional', 'WXYZ54321K', '194J', 'k', 'k', '', ''),
        (0, 5, 'A', 'payment', 'Globex professional', 'WXYZ54321K', '194J', 'a', '', '', '01/02/2024'), (2, 2, 'C', 'total', 'Motor dealers', 'MOTO11111D', '', 'a', 'k', '', ''))
        SELECT doc_id, table_no, row_no, part, kind, reported_by, tan, section, CASE p WHEN 'a' THEN a WHEN 'k' THEN k ELSE 0 END AS paid_c, CASE d WHEN 'a' THEN a WHEN 'k' THEN k ELSE 0 END AS deducted_c,
        CASE e WHEN 'a' THEN a WHEN 'k' THEN k ELSE 0 END AS deposited_c, date FROM c0, t""",
    "information_table_entries": f"""WITH {_CUSTOMER}, t(table_no, row_no, section, reported_by, description, p, m, date) AS (VALUES
        (0, 1, 'interest', '', 'before a source', 'k', '', '01-04-2024'), (0, 3, 'interest', 'First Bank', 'Savings account one', 'a', 'k', '02-04-2024'), (0, 4, 'interest', 'First Bank', 'Savings account two', 'k', '', ''),
        (1, 1, 'dividend', '', 'Shares of acme', 'k', '', ''), (1, 3, 'dividend', 'Second Registrar', 'Shares of globex', 'a', '', ''), (2, 1, 'other_income', '', '', 'k', '', ''))
        SELECT doc_id, table_no, row_no, section, reported_by, description, CASE p WHEN 'a' THEN a ELSE k END AS amount_c, CASE m WHEN 'k' THEN k ELSE 0 END AS modified_c, date FROM c0, t""",
    "income_breakdown": f"""WITH {ENR}, o AS (SELECT account_id, credit_class, CAST(sum(amount_c) AS BIGINT) AS c, list_position(['salary', 'business', 'interest', 'dividend', 'rental'], credit_class) AS place FROM enr
        WHERE credit_class IN ('salary', 'business', 'interest', 'dividend', 'rental') GROUP BY ALL HAVING sum(amount_c) > 0), s AS (SELECT account_id, CAST(sum(c) AS BIGINT) AS total, CAST(sum((c + 50) // 100) AS BIGINT) AS parts,
        CAST(sum(c * 10000 // total1) AS BIGINT) AS floors FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY account_id) AS BIGINT) AS total1 FROM o) GROUP BY ALL)
        SELECT account_id, credit_class, CAST((c + 50) // 100 + CASE WHEN row_number() OVER (PARTITION BY account_id ORDER BY c DESC, place) = 1 THEN (total + 50) // 100 - parts ELSE 0 END AS BIGINT) AS amount,
        CAST(c * 10000 // total + CASE WHEN row_number() OVER (PARTITION BY account_id ORDER BY (c * 10000) % total DESC, place) <= 10000 - floors THEN 1 ELSE 0 END AS BIGINT) AS share_bp FROM o JOIN s USING (account_id)""",
    "consistency_warnings": f"""WITH {ENGINE.replace(LED, _NOISY_LED)}, sums AS (SELECT account_id, CAST(coalesce(sum(amount_c) FILTER (credit_class <> 'non_income'), 0) AS BIGINT) AS classes FROM enr GROUP BY ALL)
        SELECT account_id, concat_ws(',', CASE WHEN foir NOT BETWEEN 0 AND 200 THEN 'foir' END, CASE WHEN dep NOT BETWEEN 0 AND 100 THEN 'loan_dependency' END, CASE WHEN loan_eligible_c < 0 THEN 'eligible' END,
        CASE WHEN remaining_emi_c < 0 THEN 'capacity' END) AS errors, concat_ws(',', CASE WHEN abs(CAST(emi_c AS DOUBLE) / n_months - monthly_emi_c) > 5000 THEN 'emi' END,
        CASE WHEN total_cr_c > 0 AND total_dr_c > 0 AND classes * 100 > total_cr_c * 105 THEN 'classes' END, CASE WHEN txns < 3 THEN 'few rows' END, CASE WHEN bn < txns THEN 'balances' END) AS warnings FROM kpi JOIN sums USING (account_id)""",
    "ledger_versions": f"""WITH {NOISY}, n AS (SELECT account_id, date, "desc", type, amount_c, balance_c FROM noisy UNION ALL SELECT account_id, date, "desc", type, amount_c, balance_c FROM noisy WHERE txn_id % 11 = 0),
        a AS (SELECT account_id, date, "desc", type, amount_c, balance_c, count(*) AS o, 0 AS n FROM led GROUP BY ALL UNION ALL SELECT *, 0, count(*) FROM n GROUP BY ALL),
        d AS (SELECT account_id, date, "desc", type, amount_c, balance_c, sum(o) AS o, sum(n) AS n FROM a GROUP BY ALL)
        SELECT account_id, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS removed, CAST(sum(least(o, n)) AS BIGINT) AS unchanged FROM d GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
