"""Hard negatives of labelled vectors by Fagin's threshold algorithm.

Vectors become integers (floor of ``SCALE`` times each component); a score is the inner product
with the anchor, exact. An anchor's positives are its best other rows of the same label. The
negatives of a positive are the best rows of other labels whose score lies between
``NEAR`` per cent of the positive's and the positive's own.

The stated anchors meet all rows in cells of a grid: each cell holds at most about
``ROWS_PER_CELL`` rows and ``ANCHORS_PER_CELL`` anchors, whatever their labels, so no label,
however frequent, is a group. In a cell every dimension has a list of the rows in order of that
component, built once. For an anchor the lists are read from the end that its sign says, in
steps; rows that come up for the first time get their score from the whole vector; what the
lists' current entries would give together bounds all rows not seen. A window is done once that
threshold is strictly below its last place (so that ties are complete), or below its lower end.
Lists are read in depths that double, so a step is one gather and one product; in many
dimensions a threshold falls slowly and most rows are seen, which costs time, never results.

The best of each cell are merged by rank: positives first, and, with windows that the positives
set, negatives in a second pass over the cells.

Odd rows: a null label, a null vector, and a null or non-finite component exclude a row. Rows of
one id are rows of their own. A null id comes after all others among equal scores and is no
anchor. Vectors of different lengths are compared as if the shorter one ended in zeros. A score
that 64 bits can't hold is an error. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.llm.common import pick
from ledgersieve.shipping import ship_package
from ledgersieve.sources.kept import kept

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
NEAR = 80
ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10
ROWS_PER_CELL = 8192
ANCHORS_PER_CELL = 4096
FIRST_DEPTH = 8
_LAST = np.iinfo(np.int64).max  # stands for a null id: after all others


class Lists:
    """The rows of a cell with one list for each dimension, in order of its component."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, keys: np.ndarray):
        self.vectors, self.ids, self.labels, self.keys = vectors, ids, labels, keys
        self.order = np.argsort(vectors.T, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)
        self.largest = int(np.abs(vectors).max(initial=0))
        self._as: dict[type, np.ndarray] = {}

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products, by the narrowest arithmetic in which they are exact."""
        bound = self.largest * int(np.abs(anchor).sum())
        if bound >= 2**63:
            raise ValueError("An inner product of these vectors doesn't fit into 64 bits.")
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        if kind not in self._as:
            self._as[kind] = self.vectors.astype(kind)
        vectors = self._as[kind]
        if 4 * len(rows) > len(vectors):  # in order, all of them are cheaper than a gather
            return (vectors @ anchor.astype(kind))[rows].astype(np.int64)
        return (vectors[rows] @ anchor.astype(kind)).astype(np.int64)

    def access(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows seen for the first time, their scores, and a bound of all others (None: no others)."""
        n, depth, before = len(self.ids), FIRST_DEPTH, 0
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        while True:
            depth = min(depth, n)
            came = np.zeros(n, bool)
            came[self.order[up, n - depth:n - before].ravel()] = True
            came[self.order[down, before:depth].ravel()] = True
            came &= ~seen
            seen |= came
            last = depth == n or seen.all()
            if last:  # also where no component of the anchor differs from zero
                came |= ~seen
            rows = np.flatnonzero(came)
            bound = None if last else int(
                self.sorted[up, n - depth] @ anchor[up] + self.sorted[down, depth - 1] @ anchor[down])
            yield rows, self.scores(rows, anchor), bound
            if last:
                return
            before, depth = depth, 2 * depth

    def best(self, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], k: int,
             ) -> list[np.ndarray]:
        """For each window of scores its first k fitting rows, as (row, score) in order."""
        low = min(lo for lo, _ in windows)
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        found: dict[int, np.ndarray] = {}
        for new, points, bound in self.access(anchor):
            good = fits[new] & (points >= low)
            rows, scores = np.append(rows, new[good]), np.append(scores, points[good])
            for i, (lo, hi) in enumerate(windows):
                if i in found:
                    continue
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                enough = len(inside) >= k
                kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k] if enough else 0
                if bound is None or bound < lo or enough and bound < kth:
                    if enough:
                        inside = inside[scores[inside] >= kth]
                    at = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))][:k]
                    found[i] = np.stack([rows[at], scores[at]], axis=1)
            if len(found) == len(windows):
                break
        return [found[i] for i in range(len(windows))]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of integers as rows of equal width, filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy()
    flat = pc.list_flatten(column).to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _width(*tables: pa.Table) -> int:
    return max(0, *(pc.max(pc.list_value_length(t["x"])).as_py() or 0 for t in tables))


def _cell(rows: pa.Table, width: int) -> Lists:
    ids = rows["vec_id"].fill_null(_LAST).to_numpy()
    return Lists(_matrix(rows["x"], width), ids, rows["label"].to_numpy(), rows["key"].to_numpy())


_FOUND = "anchor_key long, anchor_id long, place int, positive_id long, positive_score long, " \
         "found_id long, found_score long"


def _answer(found: list[tuple]) -> pa.Table:
    names = [part.split()[0] for part in _FOUND.split(", ")]
    kinds = [pa.int32() if name == "place" else pa.int64() for name in names]
    columns = list(zip(*found)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _id(value: int) -> int | None:
    return None if value == _LAST else int(value)


def _positives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best other rows of the anchors' labels in a cell."""
    found: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        width = _width(rows, anchors)
        cell, vectors = _cell(rows, width), _matrix(anchors["x"], width)
        whole = [(-2**63, 2**63 - 1)]
        keys, ids, labels = (anchors[c].to_numpy() for c in ("key", "vec_id", "label"))
        for vector, key, anchor, label in zip(vectors, keys, ids, labels):
            fits = (cell.labels == label) & (cell.keys != key)
            for row, score in cell.best(vector, fits, whole, POSITIVES)[0]:
                found.append((key, anchor, 0, None, None, _id(cell.ids[row]), score))
    return _answer(found)


def _negatives(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """The best rows of other labels in a cell, for each positive of each anchor."""
    found: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        width = _width(rows, anchors)
        cell, vectors = _cell(rows, width), _matrix(anchors["x"], width)
        keys, ids, labels = (anchors[c].to_numpy() for c in ("key", "vec_id", "label"))
        positives = anchors["positives"].to_pylist()
        for vector, key, anchor, label, own in zip(vectors, keys, ids, labels, positives):
            own = [p for p in own if p["score"] >= 0]  # below zero the window is empty
            windows = [(-(-NEAR * p["score"] // 100), p["score"]) for p in own]
            if not windows:
                continue
            for p, best in zip(own, cell.best(vector, cell.labels != label, windows, NEGATIVES)):
                found += [(key, anchor, p["place"], p["id"], p["score"], _id(cell.ids[row]), score)
                          for row, score in best]
    return _answer(found)


def prepared(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: key, vec_id, label and the integer vector x."""
    named = pick(embeddings, "vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS)
    return named.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"),
        F.coalesce(label, F.col("label")).cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double"))).alias("x"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    ship_package(embeddings.sparkSession)
    rows = kept(prepared(embeddings), "vectors")
    anchors = kept(rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0), "anchors")
    sizes = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % ANCHOR_EVERY == 0)).first()
    down, across = (max(1, -(-n // most)) for n, most in zip(sizes, (ROWS_PER_CELL, ANCHORS_PER_CELL)))
    block = lambda parts: F.expr(f"pmod(xxhash64(key), {parts}L)")
    every = lambda parts: F.explode(F.expr(f"sequence(0L, {parts - 1}L)"))

    def meet(anchors: DataFrame, work) -> DataFrame:
        cells = rows.withColumn("row_block", block(down)).withColumn("b", every(across))
        asked = anchors.withColumn("b", block(across)).withColumn("row_block", every(down))
        return cells.groupBy("row_block", "b").cogroup(asked.groupBy("row_block", "b")).applyInArrow(
            work, _FOUND)

    in_order = [F.desc("found_score"), F.asc_nulls_last("found_id")]
    place = F.row_number().over(Window.partitionBy("anchor_key").orderBy(*in_order))
    positives = meet(anchors, _positives).withColumn("place", place).filter(
        F.col("place") <= POSITIVES).groupBy(F.col("anchor_key").alias("key")).agg(F.collect_list(
            F.struct("place", F.col("found_id").alias("id"), F.col("found_score").alias("score")))
            .alias("positives"))
    known = kept(anchors.join(positives, "key"), "anchors-with-positives")
    rank = F.row_number().over(Window.partitionBy("anchor_key", "place").orderBy(*in_order))
    return meet(known, _negatives).withColumn("rank", rank).filter(
        F.col("rank") <= NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"),
        "positive_score", F.col("found_score").alias("negative_score"))


def sql() -> str:
    """The same rows for DuckDB, every anchor beside every row."""
    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS key, vec_id,
    CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.key, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    list_dot_product(a.x, r.x)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.key <> r.key),
positives AS (
  SELECT key, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= {POSITIVES}),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.key, p.place ORDER BY s.score DESC, s.vec_id) AS place
  FROM positives p JOIN scored s ON s.key = p.key AND NOT s.same
    AND {NEAR} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE place <= {NEGATIVES}"""
