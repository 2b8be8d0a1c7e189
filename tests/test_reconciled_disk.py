"""The reconciliation moves an invoice to its number once and stores nothing."""

import pytest

from ledgerloom.operators import gst
from ledgerloom.plans import catalog

SIDE = "row_no long, invoice_no string, gstin string, itc_c long"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gstr2b_rows", "gstr2b_summary", "credit_position"])
def test_invoices_meet_by_number_once_and_are_not_stored(spark, name):
    lines = plan(getattr(catalog, name)(spark, "/root/testdata/sf0.001")).splitlines()
    assert not [x for x in lines if "ExistingRDD" in x]
    assert len([x for x in lines if "lineitem.parquet" in x]) == 1
    assert len([x for x in lines if "Exchange hashpartitioning(upper(" in x]) == 1
    assert not [x for x in lines if "Exchange hashpartitioning(inv#" in x]


def test_two_tables_meet_in_one_shuffle(spark):
    s, r = spark.createDataFrame([(1, "a", "G1", 5, True)], SIDE + ", itc_eligible boolean"), spark.createDataFrame([(8, "A", "G1", 5)], SIDE)
    assert plan(gst.reconcile(s, r, numbers=True)).count("Exchange ") == 1


def test_used_rows_are_settled_without_an_own_row(spark):
    s = spark.createDataFrame([(1, "a", "G1", 500, True), (2, "A", "g1", 900, True), (3, "a", None, 500, True), (4, None, "G1", 70, False)], SIDE + ", itc_eligible boolean")
    r = spark.createDataFrame([(5, "A", "G2", 500), (6, "a", "g1", 500), (7, "a", "G1", 550), (8, "a", "g1", 560), (9, "", "G9", 40)], SIDE)
    got = {(x.s_row, x.r_row, x.status, x.claim_c) for x in gst.reconcile(s, r).collect()}
    assert got == {
        (1, 8, "Matched", 500), (2, 8, "Amount Mismatch", 560), (3, 5, "Matched", 500), (4, 9, "GSTIN Mismatch", 0), (None, 6, "In Purchase Register only", 0),
        (None, 7, "In Purchase Register only", 0),
    }
    at = gst.credit_position(gst.settled(gst.entries(s, r))).first()
    assert (at.statement_itc_c, at.register_itc_c, at.only_register_c, at.blocked_c) == (1970, 2150, 1050, 70)
