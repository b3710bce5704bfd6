"""Quality rules: boosted trees over document statistics.

Statistics of every whole text are computed once and written. Trees are fitted on a bounded
sample of labelled documents and flattened into node arrays, which score a batch of rows
level by level. On the features in FALLING the score can only fall as the feature grows, so
that more symbols, repetition or capitals never help a document.

Two plain rules stand before the model: under 50 words, or over half of the words inside
3-word windows that occur at least twice.

Defined results: null and empty texts have no words and fail the plain rules; repeated rows
get equal rows; a null doc_id stays null and trains nothing; labels that are null are left
out and repeated labels are averaged; without labels only the plain rules decide; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import map_texts, pick
from ledgersieve.llm.statistics import NAMES, statistics
from ledgersieve.sources.kept import kept

FEATURES = ("symbols", "symbol_chars", "dup_lines", "repeats", "capitals", "marks", "top_word",
            "variety", "word_length", "letters", "log_words", "log_lines")
#: Features on which the score may only fall.
FALLING = ("symbols", "symbol_chars", "dup_lines", "repeats", "capitals", "marks")


@dataclass(frozen=True)
class RulesConfig:
    #: Expected number of labelled documents the trees are fitted on, at most twice as many.
    training_rows: int = 20_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 64
    least_rows: int = 5
    threshold: float = 0.5
    min_words: int = 50


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    def start():
        return lambda texts: list(map(list, zip(*[statistics(t) for t in texts], strict=True)))
    made = ", ".join(f"{name} long" for name in NAMES)
    return map_texts(pick(docs, "doc_id", "text"), ["doc_id"], made, start)


def features(rows: pd.DataFrame) -> np.ndarray:
    n = np.maximum(rows["n_words"].to_numpy(float), 1)
    chars = np.maximum(rows["word_chars"].to_numpy(float), 1)
    lines = np.maximum(rows["n_lines"].to_numpy(float), 1)
    return np.column_stack([
        rows["n_symbols"] / n, rows["n_symbols"] / chars, rows["n_dup_lines"] / lines,
        rows["n_repeat_words"] / n, rows["n_upper"] / np.maximum(rows["n_letters"], 1),
        rows["n_marks"] / n, rows["n_top_word"] / n, rows["n_distinct_words"] / n,
        rows["word_chars"] / n, rows["n_letters"] / chars, np.log2(n), np.log2(lines)])


@dataclass
class Trees:
    """All trees in one set of node arrays; ``roots`` are where each begins."""
    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    base: float = 0.0
    depth: int = 0

    def add(self, value: float) -> int:
        """A leaf points to itself, so that a walk of fixed length ends in it."""
        at = len(self.value)
        for column, x in ((self.feature, 0), (self.cut, 0.0), (self.left, at), (self.right, at),
                          (self.value, value)):
            column.append(x)
        return at

    def frozen(self) -> dict[str, np.ndarray]:
        return {name: np.array(getattr(self, name))
                for name in ("feature", "cut", "left", "right", "value", "roots", "base", "depth")}


def margin(x: np.ndarray, nodes: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of the leaves that each row reaches, all trees at once."""
    at = np.broadcast_to(nodes["roots"], (len(x), len(nodes["roots"])))
    rows = np.arange(len(x))[:, None]
    for _ in range(int(nodes["depth"])):
        down = x[rows, nodes["feature"][at]] <= nodes["cut"][at]
        at = np.where(down, nodes["left"][at], nodes["right"][at])
    return nodes["base"] + nodes["value"][at].sum(1)


def probability(x: np.ndarray, nodes: dict[str, np.ndarray]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin(x, nodes), -50, 50)))


def _best_split(codes, cuts, slope, bend, rows, bounds, cfg):
    """The split of largest gain that keeps falling features falling, or None."""
    low, high = bounds
    best, total_s, total_b = None, slope[rows].sum(), bend[rows].sum()
    for place, name in enumerate(FEATURES):
        own = codes[rows, place]
        size = len(cuts[place]) + 1
        s, b, n = (np.cumsum(np.bincount(own, w, size))[:-1]
                   for w in (slope[rows], bend[rows], np.ones(len(rows))))
        if not len(s):
            continue
        left = np.clip(-s / (b + 1), low, high)
        right = np.clip(-(total_s - s) / (total_b - b + 1), low, high)
        gain = -(s * left + 0.5 * (b + 1) * left ** 2
                 + (total_s - s) * right + 0.5 * (total_b - b + 1) * right ** 2)
        fits = (n >= cfg.least_rows) & (len(rows) - n >= cfg.least_rows)
        if name in FALLING:
            fits &= left >= right
        gain = np.where(fits, gain, -np.inf)
        at = int(gain.argmax())
        if best is None or gain[at] > best[0]:
            best = (gain[at], place, at, left[at], right[at])
    whole = np.clip(-total_s / (total_b + 1), low, high)
    least = -(total_s * whole + 0.5 * (total_b + 1) * whole ** 2) + 1e-6
    return best if best is not None and best[0] > least else None


def fit(x: np.ndarray, y: np.ndarray, cfg: RulesConfig) -> dict[str, np.ndarray]:
    """Second-order boosting on binned features with bounds handed down to the branches."""
    trees = Trees(depth=cfg.depth)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees.base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, cfg.bins + 1)[1:-1], method="lower"))
            for c in x.T]
    codes = np.column_stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T)])
    score = np.full(len(y), trees.base)
    for _ in range(cfg.trees):
        guess = 1 / (1 + np.exp(-score))
        slope, bend = guess - y, guess * (1 - guess)
        root = trees.add(0.0)
        trees.roots.append(root)
        todo = [(root, np.arange(len(y)), (-4.0, 4.0), 0)]
        while todo:
            node, rows, bounds, level = todo.pop()
            split = _best_split(codes, cuts, slope, bend, rows, bounds, cfg) \
                if level < cfg.depth else None
            if split is None:
                leaf = np.clip(-slope[rows].sum() / (bend[rows].sum() + 1), *bounds)
                trees.value[node] = float(cfg.rate * leaf)
                score[rows] += trees.value[node]
                continue
            _, place, at, left, right = split
            middle = (left + right) / 2
            low, high = bounds
            falling = FEATURES[place] in FALLING
            trees.feature[node], trees.cut[node] = place, float(cuts[place][at])
            trees.left[node], trees.right[node] = trees.add(0.0), trees.add(0.0)
            down = codes[rows, place] <= at
            todo += [(trees.left[node], rows[down], (middle, high) if falling else bounds, level + 1),
                     (trees.right[node], rows[~down], (low, middle) if falling else bounds, level + 1)]
    return trees.frozen()


def train(stats: DataFrame, labels: DataFrame, cfg: RulesConfig = RulesConfig()):
    """Node arrays fitted on labelled documents, or None without labels."""
    told = (pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
            .groupBy("doc_id").agg(F.avg("quality").alias("__good")))
    part = min(1.0, cfg.training_rows / max(told.count(), 1))
    told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = (stats.join(told, "doc_id").dropDuplicates(["doc_id"])
            .limit(2 * cfg.training_rows).toPandas().sort_values("doc_id"))
    if not len(rows):
        return None
    return fit(features(rows), (rows["__good"].to_numpy(float) > 0.5).astype(float), cfg)


def judge(docs: DataFrame, labels: DataFrame, cfg: RulesConfig = RulesConfig()) -> DataFrame:
    """Counts, the plain rules' and the final verdict for each row of ``docs``."""
    stats = kept(document_statistics(docs), "statistics")
    nodes = docs.sparkSession.sparkContext.broadcast(train(stats, labels, cfg))  # a few hundred nodes

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = np.ones(len(frame)) if nodes.value is None \
                else probability(features(frame), nodes.value)
            yield frame.assign(score=score)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    scored = stats.mapInPandas(rate, f"{schema}, score double")
    failed = ((F.col("n_words") < cfg.min_words)
              | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= cfg.threshold))


def contract(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "score")
