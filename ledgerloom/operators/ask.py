"""Guarded ad-hoc SQL over a ledger view."""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions that a question about a ledger needs; all others are refused, those that reach the JVM, files or the session among them.
FUNCTIONS = frozenset(
    """abs any_value approx_count_distinct avg bool_and bool_or bround cast ceil ceiling coalesce collect_list collect_set concat concat_ws contains count count_if cume_dist
    current_date date_add date_format date_sub date_trunc dateadd datediff day dayofmonth dayofweek dayofyear dense_rank endswith every exp extract first first_value floor format_number
    greatest hour if ifnull ilike initcap instr isnotnull isnull lag last last_day last_value lead least left len length like listagg ln locate log log10 lower lpad ltrim make_date max
    max_by mean median min min_by mod month months_between nth_value ntile nullif nvl nvl2 percent_rank percentile position pow power quarter rank regexp_extract regexp_like
    regexp_replace replace reverse right rlike round row_number rpad rtrim sign some split sqrt startswith std stddev stddev_pop stddev_samp string_agg substr substring sum to_date
    trim trunc try_divide try_to_date upper var_pop variance weekday weekofyear width_bucket year and or not in between is case when""".split()
)
LITERAL = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\"""", re.S)
#: Date patterns of another dialect and their letters here.
DATE_LETTERS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


#: Nodes of a resolved plan that a question may have; its only table is the view.
NODES = frozenset(
    """Project Filter Aggregate Sort Distinct Deduplicate GlobalLimit LocalLimit Offset Window Join Union Intersect Except SubqueryAlias WithCTE CTERelationDef CTERelationRef
    OneRowRelation UnionLoop UnionLoopRef Subquery AsOfJoin""".split()
)
#: Parts of expressions that have no name of a function: operators, columns, frames, subqueries, conversions.
PARTS = frozenset(
    """Alias AttributeReference OuterReference Literal Cast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Add Subtract Multiply Divide
    IntegralDivide Remainder UnaryMinus UnaryPositive IsNull IsNotNull In InSubquery ListQuery Exists ScalarSubquery LateralSubquery CaseWhen If Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny
    Between SortOrder AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnboundedPreceding$ UnboundedFollowing$ CurrentRow$ RowFrame$ RangeFrame$
    Extract Year Month DayOfMonth Concat DateAdd DateAddInterval DateSub TimestampAddInterval Interval DatetimeSub SubtractDates SubtractTimestamps Complete$ LateralColumnAliasReference VariableReference
    CheckOverflow PromotePrecision TempResolvedColumn NamedLambdaVariable ArrayContains""".split()
)


def view(rows: DataFrame) -> DataFrame:
    """The queryable table: id, date, desc, type, amount, balance; unknown amounts and balances are 0."""
    rupees = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(100.0)
    return rows.select(F.col("txn_id").alias("id"), F.col("date").cast("string").alias("date"), "desc", "type", rupees("amount_c").alias("amount"), rupees("balance_c").alias("balance"))


def _dates(sql: str) -> str:
    """strftime calls as date_format; what they format may itself hold calls, brackets and texts."""
    out, at = [], 0
    for m in re.finditer(r"(?i)\bstrftime\s*\(\s*'([^']*)'\s*,", sql):
        if m.start() < at:
            continue
        depth, end, quoted = 1, m.end(), False
        while end < len(sql) and depth:
            quoted ^= sql[end] == "'"
            depth += 0 if quoted else (sql[end] == "(") - (sql[end] == ")")
            end += 1
        form = m[1]
        for a, b in DATE_LETTERS.items():
            form = form.replace(a, b)
        out += [sql[at : m.start()], f"date_format({_dates(sql[m.end() : end - 1].strip())}, '{form}')"]
        at = end
    return "".join(out) + sql[at:]


def bridged(sql: str) -> str:
    """A statement as SQLite means it: LIKE ignores case, strftime formats dates, and a division by zero gives null."""

    sql = _dates(sql)
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"'{len(kept) - 1}'"

    bare = LITERAL.sub(hide, sql)
    bare = re.sub(r"(?i)\blike\b", "ILIKE", bare)
    bare = re.sub(r"/\s*((?:[A-Za-z_][\w.]*\s*)?\((?:[^()]|\([^()]*\))*\)|[A-Za-z_][\w.]*|\d+(?:\.\d+)?)", r"/ nullif(\1, 0)", bare)
    return re.sub(r"'(\d+)'", lambda m: kept[int(m[1])], bare)


def _each(seq: JavaObject):
    return (seq.apply(k) for k in range(seq.size()))


class SafeQuery:
    """Answers SELECT (or WITH) statements about one table, `transactions`, and nothing else.

    It has a session of its own, whose only table is that view, so nothing of the caller's session can be seen or
    changed. A statement is parsed and analysed, not run, and the resolved plan is walked: every leaf must be the view,
    every node a relational one of `NODES`, every expression the class of one of `FUNCTIONS` or of `PARTS`. So names don't
    matter, quoted or not, nor in which scope a common table is defined. Before that, tables with more than one name part
    (files, other catalogs), table functions, hints and commands are refused in the parsed plan, since resolving them may
    read files. A refused or wrong statement gives {"error": ...}. `close` drops the view and ends the answers.

    A statement without a LIMIT gets one of `limit` rows, as an answer for reading; `limit=None` gives all rows.
    """

    def __init__(self, spark: SparkSession, transactions: DataFrame, limit: int | None = 50):
        self.session, self.limit = transactions.sparkSession.newSession(), limit
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.session.conf.set(key, transactions.sparkSession.conf.get(key))
        # a division by zero or a text that is no number gives null, as in the dialect that questions are asked in
        self.session.conf.set("spark.sql.ansi.enabled", "false")
        self.jvm, self.java = self.session._jvm, self.session._jsparkSession
        self._frame(transactions._jdf.logicalPlan()).createOrReplaceTempView("transactions")
        registry = self.java.sessionState().functionRegistry()
        named = (registry.lookupFunction(self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(f)) for f in FUNCTIONS)
        self.classes = PARTS | {found.get().getClassName().rsplit(".", 1)[-1] for found in named if found.isDefined()}

    def __enter__(self) -> SafeQuery:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _frame(self, plan: JavaObject) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.java, plan), self.session)

    def close(self) -> None:
        self.session.catalog.dropTempView("transactions")

    def _parsed(self, text: str) -> JavaObject:
        """The parsed plan, under this session's settings: operators take theirs from the active session."""
        sessions = self.jvm.org.apache.spark.sql.classic.SparkSession
        before = sessions.getActiveSession()
        sessions.setActiveSession(self.java)
        try:
            return self.java.sessionState().sqlParser().parsePlan(text)
        finally:
            sessions.setActiveSession(before.get()) if before.isDefined() else sessions.clearActiveSession()

    def _parsed_badly(self, plan: JavaObject) -> str | None:
        """What of a parsed plan isn't even to be resolved."""
        name = plan.getClass().getSimpleName()
        if name == "UnresolvedRelation" and plan.multipartIdentifier().size() > 1:
            return f"Unknown table {plan.multipartIdentifier().mkString('.')}"
        if name.startswith(("UnresolvedTableValuedFunction", "UnresolvedTVF", "UnresolvedHint", "UnresolvedInlineTable", "Generate", "Script", "Relation", "Insert")) or "Command" in name:
            return "Only SELECT statements over transactions are allowed"
        for child in [*_each(plan.children()), *(c for c in _each(plan.innerChildren()) if self._is(c, "plans.logical.LogicalPlan"))]:
            why = self._parsed_badly(child)
            if why:
                return why
        return next((w for w in map(self._subqueries_badly, _each(plan.expressions())) if w), None)

    def _is(self, thing: JavaObject, kind: str) -> bool:
        return self.jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{kind}").isInstance(thing)

    def _subqueries_badly(self, e: JavaObject) -> str | None:
        why = self._parsed_badly(e.plan()) if self._is(e, "expressions.PlanExpression") and self._is(e.plan(), "plans.logical.LogicalPlan") else None
        return why or next((w for w in map(self._subqueries_badly, _each(e.children())) if w), None)

    def _plan_refused(self, plan: JavaObject) -> str | None:
        name = plan.getClass().getSimpleName()
        if name == "View":
            return None if plan.isTempView() and plan.desc().identifier().unquotedString() == "transactions" else "Unknown table"
        if name not in NODES:
            return f"Only SELECT statements over transactions are allowed, not {name}"
        for e in _each(plan.expressions()):
            why = self._expression_refused(e)
            if why:
                return why
        children = [*_each(plan.children()), *(_each(plan.cteDefs()) if name == "WithCTE" else [])]
        return next((w for w in map(self._plan_refused, children) if w), None)

    def _expression_refused(self, e: JavaObject) -> str | None:
        name = e.getClass().getName().rsplit(".", 1)[-1]
        if name not in self.classes:
            return f"Unknown function {e.prettyName()}"
        if self._is(e, "expressions.PlanExpression"):
            why = self._plan_refused(e.plan())
            if why:
                return why
        inner = e.parameters() if self._is(e, "expressions.InheritAnalysisRules") else e.children()
        return next((w for w in map(self._expression_refused, _each(inner)) if w), None)

    def run(self, sql: str) -> DataFrame | dict:
        text = bridged(sql.strip().rstrip(";").strip())
        bare = LITERAL.sub("''", text)
        if not re.match(r"(?is)\s*(select|with)\b", bare) or ";" in bare:
            return {"error": "Only SELECT statements are allowed"}
        if "--" in bare or "/*" in bare:
            return {"error": "Comments are not allowed"}
        try:
            parsed = self._parsed(text)
            why = self._parsed_badly(parsed)
            if not why:
                found = self._frame(parsed)
                why = self._plan_refused(found._jdf.queryExecution().analyzed())
        except Exception as problem:  # whatever the statement is refused for is the answer
            return {"error": str(problem).strip().split("\n")[0]}
        if why:
            return {"error": why}
        return found if self.limit is None or re.search(r"(?i)\blimit\b", bare) else found.limit(self.limit)
