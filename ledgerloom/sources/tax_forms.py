"""Entries of tax forms from the text of their lines: a section heading holds until the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.functions.parsing import parse_amount_c

# Sections of the information statement by the words of a line, the first that fits.
SECTIONS = {
    "salary": ["salary", "wages"],
    "interest": ["interest from savings", "interest from deposit", "interest from others", "interest on income tax refund"],
    "dividend": ["dividend"],
    "securities": ["sale of securities", "purchase of securities", "sale of immovable property", "purchase of immovable property"],
    "mutual_fund": ["sale of units of mutual fund", "purchase of units of mutual fund", "mutual fund"],
    "foreign": ["foreign remittance", "foreign travel"],
    "gst_turnover": ["gst turnover", "gst purchases"],
    "rent": ["rent received", "rent payment"],
    "other_income": ["winnings", "cash deposit", "cash withdrawal", "credit card"],
    "tds_tcs": ["tax deducted at source", "tds", "tcs"],
}
DATE = r"(\d{2}[-/]\d{2}[-/]\d{4})"


def amounts(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(r"([\d,]+\.\d{2})"), F.lit(1)), parse_amount_c)


def forward(rows: DataFrame, heading: Column, otherwise: Column) -> Column:
    """The last heading up to a line of the same document."""
    return F.coalesce(F.last(heading, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")), otherwise)


def information_entries(rows: DataFrame) -> DataFrame:
    """Lines of the annual information statement that hold an amount, with their section."""
    said = R.first_match([(R.contains_any(F.lower("line"), words), name) for name, words in SECTIONS.items()], F.lit(None).cast("string"))
    rows = rows.withColumn("section", forward(rows, said, F.lit("other_income"))).withColumn("found", amounts(F.col("line"))).where("size(found) > 0")
    return rows.select(
        "doc_id", "line_no", "section", F.substring("line", 1, 120).alias("description"), F.element_at("found", 1).alias("amount_c"),
        F.coalesce(F.get("found", F.lit(1)), F.lit(0)).alias("modified_c"), F.regexp_extract("line", DATE, 1).alias("date"),
    )


def information_summary(entries: DataFrame) -> DataFrame:
    out = entries.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("section") == s, F.col("amount_c"))), F.lit(0)).alias(f"{s}_c") for s in SECTIONS])
    return out.withColumn("income_c", F.col("salary_c") + F.col("interest_c") + F.col("dividend_c") + F.col("rent_c"))


def tax_section(text: Column) -> Column:
    """The section of law under which tax was deducted, from the deductor's line."""
    t = F.lower(text)
    has = lambda *words: R.contains_any(t, list(words))
    # Sections of the law by the words of a line, the first that fits.
    return R.first_match(
        [
            (has("salary", "192"), "192"), (has("194j", "professional"), "194J"), (has("194c", "contract"), "194C"), (has("194a", "interest"), "194A"),
            (has("194b", "lottery"), "194B"), (has("194h", "commission"), "194H"), (has("194i", "rent"), "194I"),
        ],
        F.lit("other"),
    )


def credit_entries(rows: DataFrame) -> DataFrame:
    """Lines of the tax credit statement by part, A to F; part A needs a deduction account number, part B two amounts."""
    part = F.upper(F.nullif(F.regexp_extract("line", r"(?i)\bPART\s*[-–]?\s*([A-G])\b", 1), F.lit("")))
    rows = rows.withColumns({"part": forward(rows, part, F.lit("")), "heading": part.isNotNull(), "found": amounts(F.col("line")), "tan": F.regexp_extract("line", r"\b([A-Z]{4}\d{5}[A-Z])\b", 1)})
    kept = rows.where(
        ~F.col("heading") & F.col("part").isin(list("ABCDEF")) & (F.size("found") > 0)
        & ((F.col("part") != "A") | (F.col("tan") != "")) & ((F.col("part") != "B") | (F.size("found") > 1))
    )
    nth = lambda k: F.coalesce(F.get("found", F.lit(k)), F.lit(0))
    section = F.when(F.col("part") == "A", tax_section(F.col("line"))).otherwise("")
    return kept.select(
        "doc_id", "line_no", "part", "tan", section.alias("section"), nth(0).alias("paid_c"), nth(1).alias("deducted_c"), nth(2).alias("deposited_c"), F.regexp_extract("line", DATE, 1).alias("date")
    )


def credit_summary(entries: DataFrame) -> DataFrame:
    s = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    a = F.col("part") == "A"
    return entries.groupBy("doc_id").agg(
        s("paid_c", a).alias("declared_c"), s("deducted_c", a).alias("tds_c"), s("deposited_c", a).alias("deposited_c"), s("deducted_c", a & (F.col("section") == "192")).alias("salary_tds_c"),
        s("deducted_c", F.col("part") == "C").alias("tcs_c"), s("paid_c", F.col("part") == "D").alias("refund_c"), s("paid_c", F.col("part") == "E").alias("reported_c"),
    )


def taxpayer(text: Column) -> dict[str, Column]:
    """Account number, name, address and assessment year of a form's text."""
    pick = lambda pattern: F.trim(F.regexp_extract(text, pattern, 1))
    year = F.regexp_replace(pick(r"(?i)Assessment\s*Year\s*[:\-]?\s*(\d{4}\s*-\s*\d{2,4})"), " ", "")
    return {
        "pan": pick(r"\b([A-Z]{5}\d{4}[A-Z])\b"), "name": F.substring(pick(r"Name\s*[:\-]\s*([A-Z][A-Z .]+)"), 1, 60), "address": F.substring(pick(r"(?i)Address\s*[:\-]\s*(.+?)(?:\n|PAN|Assessment)"), 1, 200),
        "year": F.when(year != "", year).otherwise(pick(r"\b(20\d{2}-\d{2,4})\b")),
    }


def carried(rows: DataFrame, upper: Column, lower: Column) -> DataFrame:
    """`upper` and `lower` of every row: each holds from the row that states it; a new upper one ends the lower one."""
    order = Window.partitionBy("doc_id").orderBy("table_no", "row_no")
    rows = rows.withColumns({"__upper": upper, "__lower": lower}).withColumn("__island", F.count("__upper").over(order))
    within = Window.partitionBy("doc_id", "__island").orderBy("table_no", "row_no")
    held = rows.withColumns({"upper": F.last("__upper", ignorenulls=True).over(within), "lower": F.last("__lower", ignorenulls=True).over(within)})
    return held.withColumn("heads", F.col("__upper").isNotNull()).drop("__upper", "__lower", "__island")


TAN = r"\b([A-Z]{4}\d{5}[A-Z])\b"
NUMBER = r"^[\d,]+(\.\d+)?$"


def _cells(rows: DataFrame) -> DataFrame:
    """Trimmed cells, those that hold something, and the positive amounts among them in order."""
    rows = rows.withColumn("cells", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))))
    numbers = F.filter(F.transform(F.filter("cells", lambda c: c.rlike(r"^[\d,]+\.\d{2}$")), parse_amount_c), lambda n: n > 0)
    return rows.withColumns({"found": numbers, "joined": F.lower(F.array_join("cells", " "))}).where(F.trim("joined") != "")


def _longest(cells: Column) -> Column:
    """The longest cell of words: neither a number nor an account number."""
    worded = F.filter(cells, lambda c: (F.length(c) > 4) & ~c.rlike(TAN) & ~c.rlike(NUMBER) & ~c.rlike(DATE))
    return F.coalesce(F.array_max(F.transform(worded, lambda c, i: F.struct(F.length(c).alias("n"), (-i).alias("i"), c.alias("c"))))["c"], F.lit(""))


def credit_table_entries(rows: DataFrame) -> DataFrame:
    """Rows of the tax credit statement's tables (doc_id, table_no, row_no, cells), parts A and C.

    A heading that names a collector begins part C, one that names a deductor or its account number part A. A row with
    an account number is a deductor's (or collector's) total; rows with amounts below it are its payments, and
    `reported_by` is its name. A heading ends the deductor too.
    """
    rows = _cells(rows)
    heading = F.when(F.col("joined").contains("collector"), "C").when(F.col("joined").rlike("deductor|\\btan\\b") & (F.size("found") == 0), "A").when(F.col("joined").rlike("^part [a-g]\\b"), "")
    tan = F.regexp_extract(F.upper("joined"), TAN, 1)
    named = F.when((tan != "") & (F.size("found") > 0), F.struct(_longest(F.col("cells")).alias("name"), tan.alias("tan")))
    held = carried(rows, heading, named).where("not heads and upper in ('A', 'C') and size(found) > 0 and lower is not null")
    total = F.regexp_extract(F.upper("joined"), TAN, 1) != ""
    nth = lambda k: F.coalesce(F.get("found", F.lit(k)), F.lit(0))
    return held.select(
        "doc_id", "table_no", "row_no", F.col("upper").alias("part"), F.when(total, "total").otherwise("payment").alias("kind"), F.col("lower.name").alias("reported_by"), F.col("lower.tan").alias("tan"),
        F.when(F.col("upper") == "A", tax_section(F.col("lower.name"))).otherwise("").alias("section"), nth(0).alias("paid_c"), nth(1).alias("deducted_c"), nth(2).alias("deposited_c"),
        F.regexp_extract("joined", DATE, 1).alias("date"),
    )


def information_table_entries(rows: DataFrame) -> DataFrame:
    """Rows with amounts of the information statement's tables: a table's first row names its section, `reported by` rows the source."""
    rows = _cells(rows)
    said = R.first_match([(R.contains_any(F.col("joined"), words), name) for name, words in SECTIONS.items()], F.lit("other_income"))
    first = F.row_number().over(Window.partitionBy("doc_id", "table_no").orderBy("row_no")) == 1
    source = F.nullif(F.initcap(F.trim(F.regexp_extract("joined", r"reported by\s*:?\s*(.+)$", 1))), F.lit(""))
    held = carried(rows.withColumn("first", first), F.when(F.col("first"), said), source).where("not heads and size(found) > 0")
    worded = F.get(F.filter("cells", lambda c: (F.length(c) > 6) & ~c.rlike(NUMBER) & ~c.rlike(DATE)), F.lit(0))
    return held.select(
        "doc_id", "table_no", "row_no", F.col("upper").alias("section"), F.coalesce("lower", F.lit("")).alias("reported_by"), F.substring(F.coalesce(worded, F.lit("")), 1, 120).alias("description"),
        F.element_at("found", 1).alias("amount_c"), F.coalesce(F.get("found", F.lit(1)), F.lit(0)).alias("modified_c"), F.regexp_extract("joined", DATE, 1).alias("date"),
    )
