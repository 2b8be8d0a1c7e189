"""Exact top-k inner products with bounds from multi-resolution segment statistics.

With a vector cut into segments, a segment's inner product is at most its length times (mean times mean plus deviation
times deviation): the distance bound from segment means and deviations, told as a bound on scores. Vectors are first
turned by an orthogonal matrix fitted on a sample of `SAMPLE` rows, which changes no inner product and puts what varies
most in front. The same sample, scored exactly, gives each query a k-th best score to begin with. Then:

1. Candidates are grouped by their leading turned components; of each group the ranges of segment means and deviations
   are kept. A query goes only to groups whose bound reaches its k-th score, and a group's vectors only to blocks of
   queries that want it: groups are pruned before any vector is shuffled to be compared.
2. In a block, bounds are taken coarse to fine (`LEVELS`); what may still reach the k-th best score found so far, the
   sample's included, is kept, and exact scores are computed of the survivors alone.

Groups beyond `CANDIDATE_ROWS` are split by a hash of the id. Each task returns k rows a query; a window ranks them.
Vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors of unequal length
are not compared. A repeated row is a candidate each time (repeats are counted before they are shuffled), but no row of
the query's own id is; repeated query rows with one id and vector are one query. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed

#: Segments of each level, as shares of the vectors' length; bounds of groups are taken at `GROUP_LEVEL`.
LEVELS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)
GROUP_LEVEL = 1 / 4
#: Most rows of the sample and most numbers in it, leading components that groups are made by, and ranges of each.
SAMPLE, SAMPLE_VALUES, LEADING, RANGES = 4096, 1 << 20, 3, 4
#: Most rows of a block of queries and of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 16_384, 32_768
#: Blocks of candidates that are made at least, where there are rows for it, so that all cores have work.
TASKS, LEAST_ROWS = 48, 512
#: Queries of a block that are compared with its candidates at a time: memory is bounded by this times a block.
STEP = 64
#: Pairs of groups and query blocks that a broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST = 500_000
LONG = (1 << 63) - 1


def parts_of(width: int, level: float) -> list[np.ndarray]:
    return [at for at in np.array_split(np.arange(width), max(1, round(width * level))) if len(at)]


def features(x: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length: all means first."""
    means, spreads = [], []
    for at in parts:
        part = x[:, at]
        mean = part.mean(axis=1)
        means.append(mean * len(at) ** 0.5)
        spreads.append(np.sqrt(np.maximum((part * part).mean(axis=1) - mean * mean, 0)) * len(at) ** 0.5)
    return np.stack(means + spreads, axis=1) if parts else np.zeros((len(x), 2))


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products; whole numbers beyond a double's are added up as Python's and held to a long."""
    if len(q) == 0 or np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    wide = lambda rows: [[int(v) for v in r] for r in rows]
    sums = [sum(a * b for a, b in zip(x, y)) for x, y in zip(wide(q), wide(c))]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], dtype=np.int64)


def _slack(q: np.ndarray, c_norm: float) -> np.ndarray:
    """What rounding can take from a bound."""
    return 1 + 1e-9 * np.sqrt((q * q).sum(axis=1)) * c_norm


@dataclass
class Sample:
    """Of vectors of one length: the turn, the sample's ids and vectors, the edges of the ranges, and the groups' bounds."""

    turn: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    edges: list[np.ndarray]
    groups: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    norm: float = 0.0

    @classmethod
    def fitted(cls, ids: np.ndarray, rows: np.ndarray) -> Sample:
        width = rows.shape[1]
        turn = np.linalg.eigh(np.cov(rows.T).reshape(width, width))[1][:, ::-1] if len(rows) > 1 and np.isfinite(np.abs(rows).sum() ** 2) else np.eye(width)
        turned = rows @ turn[:, :LEADING]
        edges = [np.quantile(turned[:, k], np.arange(1, RANGES) / RANGES) for k in range(turned.shape[1])]
        return cls(turn, ids, rows, edges)

    def group(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        turned = rows @ self.turn[:, :LEADING]
        for k, edges in enumerate(self.edges):
            out = out * RANGES + np.searchsorted(edges, turned[:, k])
        return out

    def least(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best exact score among the sample, or -inf where it has fewer."""
        out = np.full(len(q), -np.inf)
        if len(self.rows) > k:
            for at in range(0, len(q), STEP):
                scores = q[at : at + STEP] @ self.rows.T
                scores[ids[at : at + STEP, None] == self.ids[None, :]] = -np.inf
                out[at : at + STEP] = np.partition(scores, -k, axis=1)[:, -k]
        return np.minimum(out - _slack(q, np.sqrt((self.rows * self.rows).sum(axis=1)).max(initial=0)), LONG)

    def wanted(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries x groups: whether a member of the group may reach the query's k-th score."""
        parts = parts_of(q.shape[1], GROUP_LEVEL)
        f, n = features(q @ self.turn, parts), len(parts)
        positive, negative = np.maximum(f, 0), np.minimum(f, 0)
        means = positive[:, :n] @ self.high[:, :n].T + negative[:, :n] @ self.low[:, :n].T
        return means + f[:, n:] @ self.high[:, n:].T + _slack(q, self.norm)[:, None] >= least[:, None]


def best_of(
    q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, turn: np.ndarray | None = None, least: np.ndarray | None = None, levels: list[np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best candidates: positions of the query and the candidate, and scores; and how many were scored.

    `least` are scores that the k-th best is known to reach; `levels` the candidates' features, coarse to fine, where
    the caller has them for several calls.
    """
    none = np.zeros(0, np.int64)
    if not len(q) or not len(c):
        return none, none, none, np.zeros(len(q), np.int64)
    width = q.shape[1]
    turn = np.eye(width) if turn is None else turn
    cuts = [parts_of(width, s) for s in LEVELS]
    levels = levels or [features(c @ turn, p) for p in cuts]
    turned = q @ turn
    own = q_ids[:, None] == c_ids[None, :]
    coarse = features(turned, cuts[0]) @ levels[0].T
    coarse[own] = -np.inf
    least = np.full(len(q), -np.inf) if least is None else least
    some = min(k, len(c))
    if some == k:
        seeds = np.argpartition(-coarse, some - 1, axis=1)[:, :some]
        seed_scores = exact(np.repeat(q, some, axis=0), c[seeds.ravel()]).reshape(len(q), some).astype(float)
        seed_scores[np.take_along_axis(own, seeds, axis=1)] = -np.inf
        least = np.maximum(least, seed_scores.min(axis=1))
    bar = least - _slack(q, np.sqrt((c * c).sum(axis=1)).max(initial=0))
    alive = ~own & (coarse >= bar[:, None])
    for parts, fine_c in zip(cuts[1:], levels[1:]):
        fine_q = features(turned, parts)
        i, j = np.nonzero(alive)
        if len(i) > alive.size // 8:
            alive &= fine_q @ fine_c.T >= bar[:, None]
        else:
            gone = np.einsum("ij,ij->i", fine_q[i], fine_c[j]) < bar[i]
            alive[i[gone], j[gone]] = False
    i, j = np.nonzero(alive)
    scores = np.empty(len(i), np.int64)
    for a in range(0, len(i), 1 << 18):
        scores[a : a + (1 << 18)] = exact(q[i[a : a + (1 << 18)]], c[j[a : a + (1 << 18)]])
    order = np.lexsort((c_ids[j], -scores, i))
    i, j, scores = i[order], j[order], scores[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], scores[place < k], alive.sum(axis=1)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch of (width, id, v): each width, where its rows are, their ids and vectors."""
    widths = batch.column(0).to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        part = batch.take(pa.array(at))
        yield int(width), at, part.column(1).to_numpy(), _matrix(part.column(2), int(width))


def top_k(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, report: bool = False
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `is_query` holds, the k highest scores, ties to smaller ids.

    With `report` also scored: of how many candidates the query's exact score was computed, those of the sample apart.
    """
    spark = vectors.sparkSession
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & sound)
    rows = rows.select(F.size("v").alias("width"), "id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.coalesce("asked", F.lit(False)).alias("asked"))
    rows = checkpointed(rows.groupBy("width", "id", "v").agg(F.max("asked").alias("asked"), F.count(F.lit(1)).alias("copies")))

    known: dict[int, Sample] = {}
    widest = rows.agg(F.max("width")).first()[0] or 1
    most = max(1, min(SAMPLE, SAMPLE_VALUES // widest))
    chosen = rows.select("width", "id", "v").orderBy(F.xxhash64("id", F.lit(3)), "id", "v").limit(most).toArrow().combine_chunks()
    for batch in chosen.to_batches():
        for width, _, ids, given in _by_width(batch):
            known[width] = Sample.fitted(ids, given)
    shared = spark.sparkContext.broadcast(known)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for width, at, _, x in _by_width(batch):
                if width in shared.value:
                    out[at] = shared.value[width].group(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "code"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            codes, copies = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for width, at, _, x in _by_width(batch):
                if width not in shared.value:
                    continue
                f, norms = features(x @ shared.value[width].turn, parts_of(width, GROUP_LEVEL)), np.sqrt((x * x).sum(axis=1))
                for code in np.unique(codes[at]):
                    mine = codes[at] == code
                    low, high, norm, n = held.get((width, int(code)), (np.inf, -np.inf, 0.0, 0))
                    held[width, int(code)] = [np.minimum(low, f[mine].min(axis=0)), np.maximum(high, f[mine].max(axis=0)), max(norm, norms[mine].max()), n + len(f[mine])]
        for (width, code), (low, high, norm, n) in held.items():
            yield pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "code": [code], "low": [low.tolist()], "high": [high.tolist()], "norm": [norm], "n": [n]})

    kinds = "width int, id long, v array<double>, "
    coded = rows.select("width", "id", "v", "asked", "copies").mapInArrow(group, f"{kinds}asked boolean, copies long, code long")
    coded = checkpointed(coded)
    partial = coded.select("width", "id", "v", "code", "copies").mapInArrow(ranges, "width int, code long, low array<double>, high array<double>, norm double, n long")
    each = partial.select("width", "code", "norm", "n", F.posexplode(F.arrays_zip("low", "high")).alias("at", "range"))
    merged = each.groupBy("width", "code", "at").agg(F.min("range.low").alias("low"), F.max("range.high").alias("high"), F.max("norm").alias("norm"), F.sum("n").alias("n"))
    found: dict[tuple[int, int], list] = {}
    for r in merged.orderBy("width", "code", "at").collect():  # as many rows as there are groups and segments
        low, high, *_ = found.setdefault((r.width, r.code), [[], [], r.norm, r.n])
        low.append(r.low)
        high.append(r.high)
    for width, sample in known.items():
        codes = sorted(c for w, c in found if w == width)
        sample.groups, sample.norm = np.array(codes, np.int64), max([found[width, c][2] for c in codes], default=0.0)
        sample.low, sample.high = (np.array([found[width, c][i] for c in codes]) for i in (0, 1))
    bounds = spark.sparkContext.broadcast(known)

    total, asked = coded.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    per_c = int(np.clip(-(-total // TASKS), LEAST_ROWS, CANDIDATE_ROWS))
    blocks = max(1, -(-asked // QUERY_ROWS))
    split = [(w, int(c), -(-found[w, c][3] // per_c)) for w, c in found]
    sizes = spark.createDataFrame(split, "width int, code long, parts int") if split else None

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, codes = np.full(batch.num_rows, -np.inf), [[0]] * batch.num_rows
            for width, at, ids, x in _by_width(batch):
                sample = bounds.value.get(width)
                if sample is not None:
                    least[at] = sample.least(ids, x, k)
                    for i, row in zip(at, sample.wanted(x, least[at])):
                        codes[i] = sample.groups[row].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "least", "codes"])

    queries = coded.where("asked").select("width", "id", "v").mapInArrow(want, f"{kinds}least double, codes array<long>")
    queries = queries.withColumns({"block": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"), "code": F.explode("codes")}).drop("codes")
    part_of = lambda rows: rows.join(F.broadcast(sizes), ["width", "code"], "left").fillna(1, ["parts"]) if sizes else rows.withColumn("parts", F.lit(1))
    queries = checkpointed(part_of(queries))
    pairs = queries.select(F.col("width").alias("of_width"), F.col("code").alias("of_code"), F.col("block").alias("for_block")).distinct()
    pairs = F.broadcast(pairs) if blocks * RANGES**LEADING <= MOST_BROADCAST else pairs
    candidates = part_of(coded.drop("asked")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int"))
    candidates = candidates.join(pairs, (F.col("width") == F.col("of_width")) & (F.col("code") == F.col("of_code")))
    candidates = candidates.select("width", F.col("for_block").alias("block"), "code", "part", "id", "v", "copies")
    queries = queries.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("width", "block", "code", "part", "id", "v", "least")

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score", "copies", "scored")
        if not left.num_rows or not right.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        width = left["width"][0].as_py()
        q_ids, c_ids = (t["id"].to_numpy() for t in (left, right))
        q, c = (_matrix(t["v"].combine_chunks(), width) for t in (left, right))
        copies, least = right["copies"].to_numpy(), left["least"].to_numpy()
        turn = bounds.value[width].turn if width in bounds.value else np.eye(width)
        levels = [features(c @ turn, parts_of(width, s)) for s in LEVELS]
        out = [np.zeros(0, np.int64)] * 5
        for at in range(0, len(q), STEP):
            i, j, s, n = best_of(q[at : at + STEP], q_ids[at : at + STEP], c, c_ids, k, turn, least[at : at + STEP], levels)
            more = [q_ids[at + i], c_ids[j], s, copies[j], np.zeros(len(i), np.int64)]
            out = [np.concatenate(x) for x in zip(out, more)]
            if report:
                tell = [q_ids[at : at + STEP], np.full(len(n), -1), np.full(len(n), -1), np.zeros(len(n), np.int64), n]
                out = [np.concatenate(x) for x in zip(out, tell)]
        return pa.table(dict(zip(names, out)))

    keys = ("width", "block", "code", "part")
    matched = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(pair, "query_id long, vec_id long, score long, copies long, scored long")
    if report:
        matched = matched.withColumn("scored", F.sum("scored").over(Window.partitionBy("query_id")))
    each = matched.where("copies > 0").withColumn("copy", F.explode(F.expr(f"sequence(1, cast(least(copies, {k}) as int))")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["scored"] if report else []))
