"""Quality classifier without hand labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. How often each
pattern of votes occurs is counted over all documents; expectation-maximisation on those
counts (there are at most 3^9 patterns) estimates each labeller's accuracy and a posterior
for each pattern. The posteriors label a bounded sample of distinct texts, on which a linear
scorer over hashed byte trigrams and binned shape features is fitted. The scorer reads every
whole text.

Defined results: a text without words (null and empty ones too) has score 0 and is rejected;
repeated rows get equal scores; a null id stays null; other columns are ignored, whatever
their names; an empty table gives an empty result; without any usable sample (no text with
words) everything is rejected. Very long texts are read whole, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import filter_texts, map_texts, pick, renamed, text_key
from ledgersieve.llm.statistics import NAMES, statistics
from ledgersieve.sources.kept import kept

LABELLERS = ("symbols", "capitals", "marks", "letters", "repeats", "variety", "top_word", "lines",
             "word_length")
BUCKETS = 4096
SHAPES = 8
BINS = 12
_BLOCK = 1 << 20


@dataclass(frozen=True)
class WeakQualityConfig:
    #: Expected number of distinct texts the scorer is fitted on, at most twice as many.
    training_rows: int = 4000
    rounds: int = 60
    steps: int = 250
    threshold: float = 0.5


def votes(counts: tuple[int, ...]) -> tuple[int, ...]:
    """One vote for each labeller: 1 good, 2 bad, 0 none."""
    x = dict(zip(NAMES, counts, strict=True))
    n, enough = max(x["n_words"], 1), x["n_words"] >= 10
    letters, lines = max(x["n_letters"], 1), max(x["n_lines"], 1)

    def say(value: float, good_below: float, bad_above: float, heard: bool = True) -> int:
        return 0 if not heard else 1 if value < good_below else 2 if value > bad_above else 0

    length = x["word_chars"] / n
    return (
        say(x["n_symbols"] / n, 0.02, 0.2),
        say(x["n_upper"] / letters, 0.2, 0.6, x["n_letters"] >= 10),
        say((x["n_marks"] + x["n_symbols"]) / n, 0.05, 0.4),
        say(-x["n_letters"] / max(x["word_chars"], 1), -0.88, -0.75, enough),
        say(x["n_repeat_words"] / n, 0.15, 0.6, enough),
        say(-x["n_distinct_words"] / n, -0.65, -0.55, enough),
        say(x["n_top_word"] / n, 0.15, 0.3, enough),
        say(x["n_dup_lines"] / lines, 0.1, 0.4, x["n_lines"] >= 3),
        0 if not enough else 1 if 4.2 < length < 7 else 2 if length < 3.5 or length > 8 else 0,
    )


def pattern(text: str | None) -> int:
    """All votes on a text as one number in base 3; -1 for a text without words."""
    counts = statistics(text)
    if not counts[0]:
        return -1
    code = 0
    for vote in votes(counts):
        code = code * 3 + vote
    return code


def estimate(patterns: dict[int, int], rounds: int) -> dict[int, float]:
    """Posterior of good for each vote pattern, by expectation-maximisation on the counts."""
    codes = sorted(patterns)
    weight = np.array([patterns[c] for c in codes], float)
    cast = np.array([[c // 3 ** i % 3 for i in reversed(range(len(LABELLERS)))] for c in codes])
    good = np.where((cast == 2).any(1), 0.1, 0.9)  # before any accuracy is known
    for _ in range(rounds):
        share = np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99)
        log = np.tile(np.log([share, 1 - share]), (len(codes), 1))
        for labeller in range(len(LABELLERS)):
            for side, belief in enumerate((good, 1 - good)):
                seen = np.bincount(cast[:, labeller], weight * belief, 3) + 1
                seen[0] = seen[1:].sum()  # a vote that isn't cast says nothing
                log[:, side] += np.log(seen / seen[0])[cast[:, labeller]]
        good = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
    return dict(zip(codes, good.tolist(), strict=True))


def features(text: str | None) -> np.ndarray:
    """Root shares of hashed byte trigrams, then one-hot bins of shape features."""
    out = np.zeros(BUCKETS + SHAPES * BINS, np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return out
    grams = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 2, 1), _BLOCK):
        b = data[at:at + _BLOCK + 2].astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
            grams += np.bincount(code, minlength=BUCKETS)
    by_byte = np.bincount(data, minlength=256)
    total, size = max(int(grams.sum()), 1), len(data)
    out[:BUCKETS] = np.sqrt(grams / total)
    top = np.partition(grams, BUCKETS - 8)[-8:]
    letters = max(int(by_byte[65:91].sum() + by_byte[97:123].sum()), 1)
    spaces = max(int(by_byte[[32, 10]].sum()), 1)
    shapes = (
        np.log2(size) / 20,
        (grams > 0).sum() / BUCKETS / (1 - np.exp(-total / BUCKETS)) if total > 1 else 1,
        min(top.max() / total * 8, 1),
        min(top.sum() / total * 2, 1),
        by_byte[65:91].sum() / letters,
        min(by_byte[[33, 35, 36, 37, 38, 42, 59, 63, 124]].sum() / spaces / 2, 1),
        min(size / spaces / 20, 1),
        min(by_byte[48:58].sum() / size * 4, 1),
    )
    for place, value in enumerate(shapes):
        out[BUCKETS + place * BINS + min(int(value * BINS), BINS - 1)] = 1
    return out


def fit(rows: np.ndarray, labels: np.ndarray, steps: int) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias."""
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    w = np.zeros(x.shape[1], np.float32)
    labels = labels.astype(np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        guess = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (guess - labels) / len(x) + 1e-5 * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        w -= 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-7)
    return w


def train(docs: DataFrame, cfg: WeakQualityConfig = WeakQualityConfig()) -> np.ndarray | None:
    """Weights of the scorer, or None if no text has words."""
    def start_votes():
        return lambda texts: [[pattern(t) for t in texts]]

    own = pick(docs, "text").select("text", text_key(F.col("text")).alias("__key"))
    voted = kept(map_texts(own, ["__key"], "__votes int", start_votes), "votes")
    heard = voted.where("__votes >= 0")
    patterns = {r["__votes"]: r["n"] for r in heard.groupBy("__votes").agg(
        F.count("*").alias("n")).collect()}  # at most 3^9 rows
    if not patterns:
        return None
    belief = estimate(patterns, cfg.rounds)
    part = min(1.0, cfg.training_rows / sum(patterns.values()))
    low = F.pmod(F.xxhash64("__key", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))
    texts = (own.where(low & F.col("text").isNotNull()).groupBy("__key")
             .agg(F.first("text").alias("text")).limit(2 * cfg.training_rows))
    fields = "__votes int, places array<int>, values array<float>"

    def start_features():
        def work(batch):
            rows = [features(t) for t in batch]
            places = [np.flatnonzero(r) for r in rows]
            return [[pattern(t) for t in batch], places,
                    [r[p] for r, p in zip(rows, places, strict=True)]]
        return work

    sample = [r for r in map_texts(texts, ["__key"], fields, start_features).collect() if r["__votes"] >= 0]
    if not sample:
        return None
    sample.sort(key=lambda r: r["__key"])
    rows = np.zeros((len(sample), BUCKETS + SHAPES * BINS), np.float32)
    for row, r in zip(rows, sample, strict=True):
        row[r["places"]] = r["values"]
    return fit(rows, np.array([belief[r["__votes"]] for r in sample]), cfg.steps)


def score(text: str | None, weights: np.ndarray | None) -> float:
    """Probability that a text is good."""
    if weights is None or not (text or "").strip(" \t\n\v\f\r"):
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(features(text) @ weights[:-1] + weights[-1], -50, 50))))


def classify(docs: DataFrame, cfg: WeakQualityConfig = WeakQualityConfig()) -> DataFrame:
    """doc_id, score and kept for each row of ``docs`` (columns doc_id and text)."""
    weights = train(docs, cfg)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # a few thousand numbers

    def start():
        def work(texts):
            scores = [score(t, sent.value) for t in texts]
            return [scores, [s >= cfg.threshold for s in scores]]
        return work

    return map_texts(pick(docs, "doc_id", "text"), ["doc_id"], "score double, kept boolean", start)


def keep_good(docs: DataFrame, cfg: WeakQualityConfig = WeakQualityConfig()) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    weights = train(docs, cfg)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    good = lambda texts: [score(t, sent.value) >= cfg.threshold for t in texts]
    return filter_texts(renamed(docs), lambda: good).toDF(*docs.columns)
