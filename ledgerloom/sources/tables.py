"""Statements from the cells of their tables: column roles from headers or from the data, and rows as transactions.

A row is (doc_id, row_no, cells). Roles are found once a document and joined to its rows by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.parsing import let, parse_amount_c, parse_date

# Header words of each role.
ROLE_WORDS = {
    "date": ["date", "txn date", "txn dt", "trans date", "transaction date", "value date", "posting date", "entry date", "book date"],
    "description": [
        "description", "narration", "particulars", "details", "transaction details", "txn description", "remarks", "narrative", "desc",
        "transaction particulars", "narration/chq. details",
    ],
    "debit": [
        "debit", "debit amount", "debit(rs)", "debit(inr)", "withdrawal", "withdrawals", "withdrawal amount", "withdrawal(rs)", "withdrawal (dr.)",
        "dr amount", "debit amt", "dr", "paid out",
    ],
    "credit": [
        "credit", "credit amount", "credit(rs)", "credit(inr)", "deposit", "deposits", "deposit amount", "deposit(rs)", "deposit (cr.)", "cr amount",
        "credit amt", "cr", "paid in",
    ],
    "balance": ["balance", "closing balance", "running balance", "available balance", "bal", "running bal", "closing bal", "balance(inr)", "balance(rs)"],
    "amount": ["amount", "txn amount", "transaction amount", "amt", "amount(rs)", "amount(inr)"],
    "reference": [
        "chq", "chq no", "chq/ref", "chq/ref no", "cheque no", "cheque number", "ref no", "ref number", "reference", "reference no", "transaction id",
        "txn id", "instrument no", "utr",
    ],
}
FOOTERS = ["opening balance", "closing balance", "brought forward", "carried forward", "page total", "grand total", "statement summary", "generated on", "end of statement"]


def plain(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(cell, F.lit(""))), r"[^a-z0-9 ./]", " "), r"\s+", " "))


def role_of(cell: Column) -> Column:
    """The role whose word fits a header cell best: the whole cell, then its start, then any part, longer words first."""
    known = [(" ".join("".join(c if c.isalnum() or c in " ./" else " " for c in w).split()), k, role) for k, (role, words) in enumerate(ROLE_WORDS.items()) for w in words]
    whole = {w: role for w, _, role in reversed(known)}
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(-k).alias("order"), F.lit(role).alias("role")) for w, k, role in known])
    fit = lambda w: F.when(cell.startswith(w), 100 + F.length(w)).when(cell.contains(w), 50 + F.length(w)).otherwise(0)
    best = F.array_max(F.transform(words, lambda x: F.struct(fit(x["word"]).alias("score"), x["order"].alias("order"), x["role"].alias("role"))))
    # headers are mostly whole words of the list, so that it is seldom gone through
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in whole.items() for x in pair]), cell), let(best, lambda b: F.when(b["score"] > 0, b["role"])))


def columns_by_header(rows: DataFrame) -> DataFrame:
    """Per document, the first row that names a date and an amount column: header_no and a column number (from 0) per role."""
    likely = rows.where(F.lower(F.array_join("cells", " ")).rlike(r"date|txn dt") & (F.size("cells") >= 3))
    cells = likely.select("doc_id", "row_no", F.posexplode("cells").alias("at", "cell")).withColumn("cell", plain(F.col("cell"))).withColumn("role", role_of(F.col("cell")))
    of = cells.groupBy("doc_id", "row_no").agg(*[F.min(F.when(F.col("role") == r, F.col("at"))).alias(r) for r in ROLE_WORDS])
    sound = of.where("date is not null and (debit is not null or credit is not null or amount is not null)")
    return sound.groupBy("doc_id").agg(F.min("row_no").alias("header_no"), *[F.min_by(r, "row_no").alias(r) for r in ROLE_WORDS])


def columns_by_data(rows: DataFrame, sample: int = 40) -> DataFrame:
    """Per document without a header: the column that mostly holds dates, the one of long texts, and up to three of numbers."""
    width = rows.groupBy("doc_id", F.size("cells").alias("width")).count().groupBy("doc_id").agg(F.max_by("width", F.struct("count", "width")).alias("width"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no"))
    seen = rows.join(width, "doc_id").where(F.size("cells") == F.col("width")).withColumn("nth", nth).where(F.col("nth") <= sample)
    cells = seen.select("doc_id", F.posexplode("cells").alias("at", "cell")).withColumn("cell", F.trim(F.coalesce("cell", F.lit(""))))
    dated, number = F.col("dated"), F.col("number")
    cells = cells.withColumns({"dated": parse_date(F.col("cell")).isNotNull(), "number": F.col("cell").rlike(r"^-?[₹$,\d]*\d[\d,]*(\.\d+)?\s*(?i:dr|cr)?\.?$")})
    share = cells.groupBy("doc_id", "at").agg(
        F.avg(dated.cast("int")).alias("dates"), F.avg((number & ~dated).cast("int")).alias("numbers"),
        F.avg(((F.length("cell") > 8) & ~number & ~dated).cast("int")).alias("texts"), F.avg(F.col("cell").rlike(r"^[\d\-]+$").cast("int")).alias("indexes"),
    )
    kind = F.when(F.col("indexes") > 0.6, "index").when(F.col("dates") > 0.4, "date").when(F.col("texts") > 0.4, "description").when(F.col("numbers") > 0.3, "number")
    kinds = share.withColumn("kind", kind).where("kind is not null")
    turn = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("at"))
    named = kinds.withColumn("turn", turn)
    number_at = lambda k: F.min(F.when((F.col("kind") == "number") & (F.col("turn") == k), F.col("at")))
    one = lambda k: F.min(F.when(F.col("kind") == k, F.col("at")))
    none = F.lit(None).cast("int")
    return named.groupBy("doc_id").agg(one("date").alias("date"), one("description").alias("description"), number_at(1).alias("debit"), number_at(2).alias("credit"), number_at(3).alias("balance")).select(
        "doc_id", F.lit(0).cast("long").alias("header_no"), "date", "description", "debit", "credit", "balance", none.alias("amount"), none.alias("reference")
    )


def generic(rows: DataFrame) -> DataFrame:
    """Transactions of any table: columns by header, or else by data; footers left out; narrations that overflow joined.

    A date that isn't in its column is looked for in all; amounts without a column are the first two positive numbers of
    the other cells; a narration without a column is what is neither date, number nor reference.
    """
    by_header = columns_by_header(rows)
    bare = rows.join(by_header.select("doc_id"), "doc_id", "left_anti")
    found = by_header.unionByName(columns_by_data(bare))
    cell = lambda role: F.trim(F.coalesce(F.get("cells", F.col(f"c.{role}")), F.lit("")))
    text = F.lower(F.array_join("cells", " "))
    body = rows.join(found.select("doc_id", F.struct(*[c for c in found.columns if c != "doc_id"]).alias("c")), "doc_id")
    body = body.where((F.col("row_no") > F.col("c.header_no")) & ~text.rlike("|".join(FOOTERS)))
    # each step names what later ones use more than once, so that nothing is parsed twice
    mapped = F.array_compact(F.array(*[F.col(f"c.{r}") for r in ROLE_WORDS]))
    others = F.filter(F.transform("cells", lambda x, i: F.when(~F.array_contains(mapped, i), F.trim(x))), lambda x: F.coalesce(x != "", F.lit(False)))
    two, one = F.col("c.debit").isNotNull() & F.col("c.credit").isNotNull(), F.col("c.amount").isNotNull()
    # other cells are read only where amounts or a narration may come from them
    lacking = ~two & ~one | (cell("description") == "")
    read = F.transform(F.when(lacking, others).otherwise(F.array().cast("array<string>")), lambda x: F.struct(x.alias("text"), parse_amount_c(x).alias("amount"), parse_date(x).alias("date")))
    body = body.withColumns({"single": cell("amount"), "left": parse_amount_c(cell("debit")), "right": parse_amount_c(cell("credit")), "others": read, "own_date": parse_date(cell("date"))})
    body = body.withColumns({"numbers": F.filter(F.transform("others", lambda o: o["amount"]), lambda n: n > 0), "single_c": parse_amount_c(F.col("single"))})
    single = F.col("single")
    signed_debit = single.rlike(r"^\(|^-|(?i:dr)\.?$") | ~single.rlike(r"(?i:cr)\.?$")
    loose = lambda k: F.coalesce(F.get("numbers", F.lit(k)), F.lit(0))
    debit = F.when(two, F.col("left")).when(~one, loose(0)).when(signed_debit, F.col("single_c")).otherwise(F.lit(0))
    credit = F.when(two, F.col("right")).when(~one, loose(1)).when(signed_debit, F.lit(0)).otherwise(F.col("single_c"))
    anywhere = F.get(F.filter(F.transform("cells", lambda x: parse_date(F.coalesce(x, F.lit("")))), lambda x: x.isNotNull()), F.lit(0))
    plain_text = F.filter("others", lambda o: (o["amount"] == 0) & o["date"].isNull() & ~o["text"].rlike(r"^[A-Za-z0-9]{2,12}[-/]?\d{5,}$"))
    said = F.array_join(F.transform(plain_text, lambda o: o["text"]), " ")
    words = F.when(F.col("c.description").isNull() | (cell("description") == ""), said).otherwise(cell("description"))
    body = body.withColumns({"date": F.coalesce("own_date", anywhere), "debit_c": debit, "credit_c": credit, "words": words, "bal": parse_amount_c(cell("balance"))})
    start = F.col("date").isNotNull() & (F.greatest("debit_c", "credit_c") > 0)
    body = body.withColumn("starts", start).withColumn("group", F.count_if("starts").over(Window.partitionBy("doc_id").orderBy("row_no"))).where("group > 0")
    # what goes on with a narration has neither date nor amount and is no page of text
    goes_on = F.col("date").isNull() & (F.greatest("debit_c", "credit_c", "bal") == 0) & F.length("words").between(3, 150)
    body = body.where(F.col("starts") | goes_on)
    more = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "words"))), lambda x: x["words"]), " ")
    at = lambda c: F.max(F.when(F.col("starts"), F.col(c)))
    out = body.groupBy("doc_id", "group").agg(at("date").alias("date"), at("debit_c").alias("debit_c"), at("credit_c").alias("credit_c"), at("bal").alias("bal"), more.alias("desc"))
    return out.select(
        "doc_id", F.col("group").alias("row_no"), "date", F.trim(F.regexp_replace("desc", r"\s+", " ")).alias("desc"), F.when(F.col("debit_c") > 0, "DR").otherwise("CR").alias("type"),
        F.when(F.col("debit_c") > 0, F.col("debit_c")).otherwise(F.col("credit_c")).alias("amount_c"), F.when(F.col("bal") > 0, F.col("bal")).alias("balance_c"),
    )


def sbi_online(rows: DataFrame, opening: DataFrame) -> DataFrame:
    """Seven cells: date, value date, words, reference, debit, credit, balance; the balance's change has the last word."""
    cell = lambda k: F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    debit, credit = parse_amount_c(cell(4)), parse_amount_c(cell(5))
    got = rows.where(F.size("cells") >= 7).withColumns(
        {
            "date": parse_date(F.regexp_replace(cell(0), r"\s+", "")),
            "desc": F.trim(F.regexp_replace(F.regexp_replace(cell(2), r"\b\d{9,}\b", ""), r"\s+", " ")),
            "said": F.when(debit > 0, "DR").when(credit > 0, "CR").otherwise("DR"),
            "amount_c": F.when(debit > 0, debit).otherwise(credit),
            "balance_c": parse_amount_c(cell(6)),
        }
    )
    got = got.where("date is not null and balance_c != 0").join(opening, "doc_id", "left")
    order = Window.partitionBy("doc_id").orderBy("row_no")
    delta = F.col("balance_c") - F.coalesce(F.lag("balance_c").over(order), F.col("opening_c"), F.lit(0))
    got = got.withColumn("delta", delta).withColumn("type", F.when(F.col("delta") < 0, "DR").when(F.col("delta") > 0, "CR").otherwise(F.col("said")))
    expected = F.when(F.col("type") == "CR", F.col("amount_c")).otherwise(-F.col("amount_c"))
    fixed = F.when((F.col("amount_c") > 0) & (F.abs(F.col("delta") - expected) > 100), F.abs("delta")).otherwise(F.col("amount_c"))
    return got.select("doc_id", F.row_number().over(order).alias("row_no"), "date", "desc", "type", fixed.alias("amount_c"), "balance_c")


def bob(rows: DataFrame) -> DataFrame:
    """Five cells, the first of which holds words, a serial number and two dates, the second hyphen of a date at times lost."""
    cell = lambda k: F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit("")))
    date = r"\d{2}-\d{2}-?\d{4}"
    repaired = F.regexp_replace(F.regexp_extract(cell(0), f"({date})", 1), r"^(\d{2}-\d{2})-?(\d{4})$", "$1-$2")
    parts = F.transform(
        F.split(cell(0), r"\n"),
        lambda x: F.trim(F.when(x.rlike(date), F.regexp_replace(F.trim(F.regexp_replace(x, date, "")), r"^\d+\s*", "")).otherwise(F.regexp_replace(F.regexp_replace(x, r"^[a-zA-Z]\s+", ""), r"\s+[a-zA-Z0-9]{1,2}$", ""))),
    )
    debit, credit = parse_amount_c(cell(2)), parse_amount_c(cell(3))
    got = rows.where(F.lower(cell(0)).rlike(date) & ~F.lower(cell(0)).contains("opening balance") & (F.greatest(debit, credit) > 0))
    return got.select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")).alias("row_no"), parse_date(repaired).alias("date"),
        F.trim(F.regexp_replace(F.array_join(F.filter(parts, lambda x: F.length(x) > 2), " "), r"\s+", " ")).alias("desc"),
        F.when(debit > 0, "DR").otherwise("CR").alias("type"), F.when(debit > 0, debit).otherwise(credit).alias("amount_c"), parse_amount_c(cell(4)).alias("balance_c"),
    )


def word_rows(words: DataFrame, gap: int = 35, least_conf: float = 30) -> DataFrame:
    """Recognised words (doc_id, page_no, text, left, top) as visual rows: a new row where tops lie more than `gap` apart.

    Where words have a conf, those of `least_conf` or less are left out. A word that repeats the one before it is dropped.
    """
    if "conf" in words.columns:
        words = words.where(F.col("conf") > least_conf)
    order = Window.partitionBy("doc_id", "page_no").orderBy("top", "left")
    breaks = F.coalesce(F.abs(F.col("top") - F.lag("top").over(order)) > gap, F.lit(False)).cast("int")
    rows = words.withColumn("breaks", breaks).withColumn("row", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("left", "top", "text"))), lambda w: w["text"])
    return rows.groupBy("doc_id", "page_no", "row").agg(F.array_join(without_doubles(listed), " ").alias("line"))


def without_doubles(tokens: Column) -> Column:
    """Tokens that don't repeat the one before them."""
    return F.transform(F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), (F.coalesce(F.get(tokens, i - 1), F.lit("")) == t).alias("again"))), lambda x: ~x["again"]), lambda x: x["t"])


def word_cells(words: DataFrame, line: int = 3, gap: int = 15) -> DataFrame:
    """Words of a page (doc_id, page_no, text, x0, x1, top) as table rows: lines of `line` points, cells where words lie `gap` or more apart."""
    words = words.withColumn("row", F.round(F.col("top") / line).cast("long"))
    order = Window.partitionBy("doc_id", "page_no", "row").orderBy("x0", "x1")
    breaks = F.coalesce(F.col("x0") - F.lag("x1").over(order) >= gap, F.lit(False)).cast("int")
    marked = words.withColumn("breaks", breaks).withColumn("cell", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cells = marked.groupBy("doc_id", "page_no", "row", "cell").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda w: w["text"]), " ").alias("text"))
    lines = cells.groupBy("doc_id", "page_no", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]).alias("cells"))
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "row")).cast("long").alias("row_no"), "cells")


def amount_columns(words: DataFrame, gap: int = 40) -> DataFrame:
    """Positions of the two rightmost clusters of amounts on each page: of balances, and of what moved them."""
    amounts = words.where(F.col("text").rlike(r"^[\d,]+\.\d{2}$"))
    order = Window.partitionBy("doc_id", "page_no").orderBy("left")
    breaks = F.coalesce(F.col("left") - F.lag("left").over(order) > gap, F.lit(False)).cast("int")
    marked = amounts.withColumn("breaks", breaks).withColumn("cluster", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    means = marked.groupBy("doc_id", "page_no", "cluster").agg(F.floor(F.avg("left")).alias("mean"))
    back = means.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.desc("cluster"))))
    pick = lambda k: F.max(F.when(F.col("turn") == k, F.col("mean")))
    return back.groupBy("doc_id", "page_no").agg(pick(1).alias("balance_left"), pick(2).alias("amount_left"))


def fill_amounts(rows: DataFrame) -> DataFrame:
    """Lost amounts (and their directions) from the change since the last known balance, in the order of the dates.

    A document whose first date is later than its last is printed newest first and read from its end.
    """
    document = Window.partitionBy("doc_id")
    turned = F.coalesce(F.min_by("date", "row_no").over(document) > F.max_by("date", "row_no").over(document), F.lit(False))
    rows = rows.withColumn("place", F.when(turned, -F.col("row_no")).otherwise(F.col("row_no")))
    before = document.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.col("balance_c") - F.last("balance_c", ignorenulls=True).over(before)
    lost = F.col("amount_c").isNull() & F.col("delta").isNotNull()
    rows = rows.withColumn("delta", delta)
    return rows.withColumns({"type": F.when(lost & (F.col("delta") < 0), "DR").when(lost & (F.col("delta") > 0), "CR").otherwise(F.col("type")), "amount_c": F.when(lost, F.abs("delta")).otherwise(F.col("amount_c"))}).drop("delta", "place")


def continuity(rows: DataFrame, opening_c: int, tolerance_c: int = 1) -> DataFrame:
    """Rows whose printed balance differs from the running one, which is set anew only where it differs.

    The running balance is the sum of all amounts so far and an offset that each decision may change. A row whose
    printed balance has the same offset as the last one printed changes nothing and never differs, so only rows at
    which the printed offset changes are folded in order: as many as a document has errors, not as it has rows.
    """
    order = Window.partitionBy("doc_id").orderBy("row_no")
    rows = rows.withColumn("total_c", F.sum("signed_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("balance_c is not null")
    rows = rows.withColumn("offset_c", F.col("balance_c") - F.col("total_c")).withColumn("was_c", F.lag("offset_c").over(order))
    turns = rows.where("was_c is null or was_c != offset_c")
    ordered = turns.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_no", "total_c", "offset_c"))).alias("rows"))
    step = """struct(
        if(abs(acc.at - x.offset_c) > {t}, x.offset_c, acc.at) as at,
        if(abs(acc.at - x.offset_c) > {t}, concat(acc.off, array(struct(x.row_no as row_no, acc.at + x.total_c as computed_c, x.offset_c + x.total_c as printed_c))), acc.off) as off)"""
    zero = f"struct(cast({opening_c} as bigint) as at, cast(array() as array<struct<row_no: bigint, computed_c: bigint, printed_c: bigint>>) as off)"
    folded = ordered.select("doc_id", F.expr(f"aggregate(rows, {zero}, (acc, x) -> {step.format(t=tolerance_c)}).off").alias("off"))
    return folded.select("doc_id", F.inline("off"))


def opening_balances(rows: DataFrame) -> DataFrame:
    """Per document the first amount of the first row that says opening balance."""
    said = rows.where(F.lower(F.array_join("cells", " ")).contains("opening balance"))
    known = F.filter(F.transform("cells", parse_amount_c), lambda c: c > 0)
    found = said.withColumn("opening_c", F.get(known, F.lit(0))).where("opening_c is not null")
    return found.groupBy("doc_id").agg(F.min_by("opening_c", "row_no").alias("opening_c"))


#: A line of text that is a table row of its own: serial number, date, the rest.
SERIAL_LINE = r"^(\d+)\s+(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\s+(.+)$"
PAGE_LINE = r"(?i)page\s+\d+\s+of\s+\d+"


def serial_of(cells: Column) -> Column:
    """The serial number in a row's first cell, if it is one."""
    return F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit(""))).try_cast("long")


def footer_rows(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows that page ends swallowed, from the text of the pages: doc_id, serial, and seven cells.

    A text line with a serial number that no table row has begins a lost row; the lines after it up to the next such line
    go on with it, page numbers left out. Its last amount is the balance and the one before what moved it.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    said = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike(PAGE_LINE))
    said = said.withColumn("serial", F.when(F.col("line").rlike(SERIAL_LINE), F.regexp_extract("line", SERIAL_LINE, 1).try_cast("long")))
    said = said.withColumn("group", F.count("serial").over(order)).where("group > 0")
    more = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    each = said.groupBy("doc_id", "group").agg(F.max("serial").alias("serial"), more.alias("lines"))
    seen = rows.select("doc_id", serial_of(F.col("cells")).alias("serial")).where("serial is not null").distinct()
    lost = each.join(seen, ["doc_id", "serial"], "left_anti")
    first = F.element_at("lines", 1)
    rest = F.substring(F.array_join(F.concat(F.array(F.regexp_extract(first, SERIAL_LINE, 3)), F.slice("lines", 2, 1 << 20)), " "), 1, 300)
    lost = lost.withColumns({"rest": rest, "date": F.regexp_extract(first, SERIAL_LINE, 2)}).withColumn("amounts", F.regexp_extract_all("rest", F.lit(r"[\d,]+\.\d{2}"), F.lit(0)))
    amount = lambda k: F.coalesce(F.get("amounts", F.size("amounts") - k), F.lit(""))
    until = F.call_function("locate", F.get("amounts", F.lit(0)), F.col("rest"))
    words = F.trim(F.when(F.size("amounts") > 0, F.substring(F.col("rest"), F.lit(1), until - 1)).otherwise(F.col("rest")))
    empty = F.lit("")
    one = lost.groupBy("doc_id", "serial").agg(F.min_by(F.struct("date", words.alias("words"), amount(2).alias("moved"), amount(1).alias("balance")), "group").alias("r"))
    return one.select("doc_id", "serial", F.array(F.col("serial").cast("string"), F.col("r.date"), F.col("r.words"), empty, F.col("r.moved"), empty, F.col("r.balance")).alias("cells"))


def with_footer_rows(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The table's rows with those lost to page ends, in the order of their serial numbers."""
    here = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("doc_id", F.last(serial_of(F.col("cells")), ignorenulls=True).over(here).alias("serial"), F.col("row_no").alias("at"), "cells")
    every = placed.unionByName(footer_rows(rows, lines).withColumn("at", F.lit(0).cast("long")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("serial").asc_nulls_first(), "at"))
    return every.select("doc_id", place.cast("long").alias("row_no"), "cells")


def missing_serials(rows: DataFrame) -> DataFrame:
    """doc_id, serial of the numbers that no row has, between the first and the last of each document."""
    seen = rows.select("doc_id", serial_of(F.col("cells")).alias("serial")).where("serial is not null").distinct()
    ends = seen.groupBy("doc_id").agg(F.min("serial").alias("first"), F.max("serial").alias("last"))
    expected = ends.select("doc_id", F.explode(F.sequence("first", "last")).alias("serial"))
    return expected.join(seen, ["doc_id", "serial"], "left_anti")


def turned_by_balance(found: DataFrame) -> DataFrame:
    """Directions as the change of the balance shows them, where it agrees with the amount; the first row's as read."""
    delta = F.col("balance_c") - F.lag("balance_c").over(Window.partitionBy("doc_id").orderBy("row_no"))
    near = lambda x: F.abs(x) <= F.greatest(F.lit(100), F.round(F.col("amount_c") / 100))
    return found.withColumn("type", F.when(near(delta - F.col("amount_c")), "CR").when(near(delta + F.col("amount_c")), "DR").otherwise(F.col("type")))
