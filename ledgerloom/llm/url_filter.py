"""URL verdicts from fixed rules and, where none fits, from a tree of path templates per host.

Urls that a rule fits are the labelled ones. Paths are cut into segments whose digits and hex ids become wildcards at
once; then the tree of each host grows from its root, as deep as `LEAST_ROWS` urls of all hosts share
the path so far and no path has more than `MOST_STARS` wildcards: a segment that holds less than `RARE` of its node's
urls joins the node's wildcard, whose branches are told apart further down. Leaves are the templates. Sibling templates whose labelled shares don't differ significantly are merged
into their parent's common branch, those without labels among them.

A template's purity is its blocked share of labelled urls, smoothed by `PRIOR` pseudo-urls at the share expected
there: that of its parent's branch and that of the same template on other hosts, each weighed by how many labels it
rests on, with the share of all urls behind them. So evidence reaches templates and hosts without labels. A template is
rejected from `REJECT` on: two blocked urls to be expected for each allowed one.

Null urls and ones without `://` have an empty host and path and the template of an empty host; the method's verdict
without evidence is allow. Counts, never urls, are grouped: repeated urls and hosts with a third of all rows add up
before they are shuffled. Urls and paths are read whole at any length. Rows are neither merged nor dropped; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls of all hosts that a path must have to be divided further, and the share of a node's below which a segment is a variable one.
LEAST_ROWS = 8
RARE = 1 / 32
PRIOR = 8.0
REJECT = 2 / 3
SIGNIFICANT = 2.0
#: Wildcards of a template; what follows is one with the path before the next.
MOST_STARS = 8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting (action, rule) as two columns; the rules are a policy list, one branch of a CASE each."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in reversed(ordered):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def segments(path: Column) -> Column:
    """Path segments with numbers and hex ids generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"\A[0-9a-fA-F-]{12,}(?=\.|\z)", "*"), r"[0-9]+", "*"))


def grown(labelled: DataFrame) -> DataFrame:
    """From shape_id, host, shape (segments), n, allowed, blocked per distinct shape: the same with its template and parent.

    A shape is held as its steps, a row each; a step's node is the path up to it (two hashes of steps and places, so
    that prefixes are neither written out nor grown one by one). A round counts all nodes at once, then fixes each path
    up to its next wildcard: every path that may join a node has as many wildcards before it, so what is counted up to
    there no longer changes. So there are as many rounds as wildcards in a row of steps that enough urls share, and
    `MOST_STARS` at most, however deep paths are. A template ends in `/**` if it stands for deeper paths.
    """
    root = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    path, whole = Window.partitionBy("shape_id").orderBy("at"), Window.partitionBy("shape_id")
    so_far = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = checkpointed(labelled.groupBy("host").agg(F.sum("n").alias("held")))
    few = (top.agg(F.sum("held")).first()[0] or 0) < LEAST_ROWS
    at, step, fixed, star = F.col("at"), F.col("step"), F.col("fixed"), F.col("star")

    steps = labelled.select("shape_id", "host", "n", F.lit(0).alias("fixed"), F.posexplode("shape").alias("at", "step"))
    for k in range(MOST_STARS + 1):
        node = F.struct(*[F.bit_xor(F.xxhash64(F.lit(seed), at, step)).over(so_far).alias(name) for seed, name in enumerate("ab")])
        nodes = steps.withColumn("node", node).withColumn("parent", F.coalesce(F.lag("node").over(path), root))
        counts = nodes.groupBy("host", "parent", "node").agg(F.sum("n").alias("in_part"))
        above = counts.select("host", F.col("node").alias("parent"), F.col("in_part").alias("held")).unionByName(top.select("host", root.alias("parent"), "held"))
        shared = counts.groupBy("node").agg((F.sum("in_part") < LEAST_ROWS).alias("closed"))
        decided = counts.join(above, ["host", "parent"]).join(shared, "node").select("host", "node", (F.col("in_part") < RARE * F.col("held")).alias("rare"), "closed")
        found = nodes.join(decided, ["host", "node"])
        found = found.withColumn("star", F.min(F.when((at >= fixed) & (F.col("rare") | (step == "*")), at)).over(whole))
        closed = F.col("closed") & (at >= fixed - 1) & (star.isNull() | (at < star))
        found = found.withColumn("cut", F.lit(0) if few else F.min(F.when(closed, at + 1)).over(whole))
        open_ = F.col("cut").isNull() & star.isNotNull()
        if k == MOST_STARS:
            found = found.withColumn("cut", F.coalesce("cut", "star"))
        found = checkpointed(found.select("shape_id", "host", "n", "at", "step", "fixed", "star", "cut"))
        if k == MOST_STARS or found.where(open_).isEmpty():
            break
        moved = {"step": F.when(open_ & (at == star), F.lit("*")).otherwise(step), "fixed": F.when(open_, star + 1).otherwise(fixed)}
        steps = found.withColumns(moved).drop("star", "cut")

    taken = F.collect_list(F.when(F.col("cut").isNull() | (at < F.col("cut")), F.struct("at", "step")))
    named = found.groupBy("shape_id").agg(F.transform(F.array_sort(taken), lambda s: s["step"]).alias("taken"), F.coalesce(F.max("at") < F.first("cut"), F.lit(True)).alias("ends"))
    written = lambda steps: F.array_join(F.transform(steps, lambda s: F.concat(F.lit("/"), s)), "")
    taken, ends = F.col("taken"), F.col("ends")
    # "/." marks the node's own page, so that it isn't the parent of what lies below it
    template = F.concat(written(taken), F.when(ends, F.lit("/.")).otherwise(F.lit("/**")))
    parent = written(F.when(ends, F.slice(taken, 1, F.greatest(F.size(taken) - 1, F.lit(0)))).otherwise(taken))
    named = named.select("shape_id", template.alias("template"), parent.alias("parent"))
    return checkpointed(labelled.join(named, "shape_id", "left").fillna("", ["template", "parent"]))


def template_tree(labelled: DataFrame) -> DataFrame:
    """Per distinct host and shape its template, whether it is merged, and its purity."""
    nodes = grown(labelled)
    sums = [F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")]
    leaves = checkpointed(nodes.groupBy("host", "parent", "template").agg(*sums))
    above = leaves.groupBy("host", "parent").agg(F.sum("allowed").alias("a1"), F.sum("blocked").alias("b1"))
    anywhere = leaves.groupBy("template").agg(F.sum("allowed").alias("a2"), F.sum("blocked").alias("b2"))
    total = leaves.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("a3"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b3"))
    tree = leaves.join(above, ["host", "parent"]).join(anywhere, "template").join(F.broadcast(total))

    every = F.col("b3") / F.greatest(F.col("a3") + F.col("b3"), F.lit(1))
    seen, around = F.col("allowed") + F.col("blocked"), F.col("a1") + F.col("b1")
    elsewhere, blocked_elsewhere = F.col("a2") + F.col("b2") - seen, F.col("b2") - F.col("blocked")
    # of the branch, of the template on other hosts, and of all: shares, weighed by n / (n + PRIOR), the last by what is left
    w1, w2 = around / (around + PRIOR), elsewhere / (elsewhere + PRIOR)
    w3 = PRIOR / (around + elsewhere + PRIOR)
    share = lambda b, n: F.coalesce(F.try_divide(b, n), F.lit(0.0))
    expected = (w1 * share(F.col("b1"), around) + w2 * share(blocked_elsewhere, elsewhere) + w3 * every) / (w1 + w2 + w3)
    pooled = share(F.col("b1"), around)
    apart = F.abs(share(F.col("blocked"), seen) - pooled) > SIGNIFICANT * F.sqrt(F.greatest(F.try_divide(pooled * (1 - pooled), seen), F.lit(0.0)))
    tree = tree.withColumn("merged", ~((seen > 0) & F.coalesce(apart, F.lit(False))))
    own = F.when(F.col("merged"), F.lit(0)).otherwise(F.col("blocked")), F.when(F.col("merged"), F.lit(0)).otherwise(seen)
    tree = tree.select("host", "template", "merged", ((own[0] + PRIOR * expected) / (own[1] + PRIOR)).alias("purity"))
    return nodes.select("host", "shape", "template").join(tree, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, and the method's template and purity."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action, "shape": segments(F.col("path"))})
    counted = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")
    )
    counted = checkpointed(counted.withColumn("shape_id", F.monotonically_increasing_id()))
    judged = rows.join(template_tree(counted), ["host", "shape"], "left")
    by_method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", by_method).alias("verdict"), "template", "purity")
