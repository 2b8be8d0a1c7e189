"""Permissive parsing of printed dates and amounts, and a guard for spreadsheet output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts in the order in which they are tried, each with its formats.
DATE_LAYOUTS = [
    (r"\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})\b", ["d MMM yyyy", "d MMMM yyyy"]),
    (r"\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2})\b", ["d MMM yy", "d MMMM yy"]),
    (r"\b(\d{2}[A-Za-z]{3}\d{4})\b", ["ddMMMyyyy"]),
    (r"\b(\d{2}[A-Za-z]{3}\d{2})\b", ["ddMMMyy"]),
    (r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})\b", ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy"]),
    (r"\b(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2})\b", ["d/M/yy", "d-M-yy", "d.M.yy"]),
    (r"\b(\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})\b", ["yyyy-M-d", "yyyy/M/d"]),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def titled(text: Column) -> Column:
    """Month names in title case, the only case that date formats know."""
    return F.concat(F.regexp_extract(text, r"^([^A-Za-z]*)", 1), F.initcap(F.regexp_extract(text, r"([A-Za-z]+)", 1)), F.regexp_extract(text, r"[A-Za-z]([^A-Za-z]*)$", 1))


#: Without this there is no date of any layout. Most cells have none, and one look is a tenth of the price of seven.
HAS_DATE = r"\d\s+[A-Za-z]{3,9}\s+\d|\d[A-Za-z]{3}\d|\d[/\-\.]\d{1,2}[/\-\.]\d"


def parse_date(text: Column) -> Column:
    """The first layout that is found and is a date of 2000 to 2035; else null.

    Texts that are nothing but a date of a usual layout are read by its format at once; no other layout is found in them.
    """

    printed = lambda text, layout: F.regexp_replace(F.regexp_extract(text, layout, 1), r"\s+", " ")
    dated = lambda day: F.when(F.year(day).between(2000, 2035), day.cast("date"))

    def reading(formats: list[str]) -> Callable[[Column], Column]:
        def days(found: Column) -> list[Column]:
            # a format whose sign the text lacks can't fit: it isn't tried, as a failure costs more than a fit
            sign = lambda form: next((s for s in "/-." if s in form), "")
            tried = lambda form: F.try_to_timestamp(titled(found) if "MMM" in form else found, F.lit(form))
            return [F.when(found.contains(sign(form)), tried(form)) if sign(form) else tried(form) for form in formats]

        return lambda found: F.when(found != "", F.coalesce(*[let(day, dated) for day in days(found)]))

    def read(t: Column) -> Column:
        slashed = F.translate(t, "-.", "//")
        as_ = lambda text, form: let(F.try_to_timestamp(text, F.lit(form)), dated)
        swapped = F.when(t.contains("/"), as_(t, "M/d/yyyy"))
        return (
            F.when(~t.rlike(HAS_DATE), F.lit(None).cast("date"))
            .when(t.rlike(r"^\d{1,2}([/\-.])\d{1,2}\1\d{4}\z"), F.coalesce(as_(slashed, "d/M/yyyy"), swapped))
            .when(t.rlike(r"^\d{1,2}([/\-.])\d{1,2}\1\d{2}\z"), as_(slashed, "d/M/yy"))
            .when(t.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}\z"), as_(F.initcap(t), "d MMM yyyy"))
            .otherwise(F.coalesce(*[let(printed(t, layout), reading(formats)) for layout, formats in DATE_LAYOUTS]))
        )

    return let(text, read)


#: Digits without and with what may stand around them; what has none of these shapes is no number, and isn't tried as one.
PLAIN_AMOUNT = r"^[0-9]+(\.[0-9]+)?\z"
_AROUND = r".,e+\-₹()\s\x00-\x20"
MAYBE_AMOUNT = rf"^(?i:[{_AROUND}]|rs|dr|cr)*+\p{{Nd}}(?i:[\p{{Nd}}{_AROUND}]|rs|dr|cr)*+$"


def parse_amount_c(text: Column) -> Column:
    """Printed money in paise without its sign: separators, currency signs, brackets and Dr or Cr marks removed; else 0."""

    def read(t: Column) -> Column:
        bare = F.regexp_replace(t, r"(?i)[,\s₹()]|rs\.?|(?:dr|cr)\.?\s*$", "")
        shown = F.when(t.rlike(PLAIN_AMOUNT), t).when(t.rlike(MAYBE_AMOUNT), bare)
        return F.coalesce(F.round(F.abs(shown.try_cast("decimal(18,4)")) * 100).cast("long"), F.lit(0))

    return let(text, read)


def guarded(text: Column) -> Column:
    """A cell that a spreadsheet would read as a formula gets a leading quote."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
