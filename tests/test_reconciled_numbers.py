"""What the reconciliation carries along, so that its users don't join for it."""

from ledgerloom.operators import gst


def test_numbers_and_credit_travel_with_the_rows(spark):
    s = spark.createDataFrame([(1, "a-1", "G1", 500, True), (2, "b", "G2", 700, True)], "row_no long, invoice_no string, gstin string, itc_c long, itc_eligible boolean")
    r = spark.createDataFrame([(8, "A-1", "G1", 500), (9, "c", "G3", 40)], "row_no long, invoice_no string, gstin string, itc_c long")
    got = {(x.statement_no, x.register_no, x.s_itc_c) for x in gst.reconcile(s, r, numbers=True).collect()}
    assert got == {("a-1", "A-1", 500), ("b", None, 700), (None, "c", None)}
