"""Benchmark passages inside documents, found with DataFrame functions only.

A passage is found if some window of a document, as long as the benchmark item in words, has
a weighted-shingle similarity of at least 0.8 with it: shared 5-word shingles, as often as
both hold them, over all shingles of either.

1. Anchors: shingles of documents that occur in an item. A window that is similar enough
   shares at least ``least`` of its shingles, and shifting it right to its first shared
   shingle loses none; so windows that begin at an anchor (or end with the text) and hold
   ``least`` anchors are all that need a look, and none is missed.
2. SimHash: a 64-bit fingerprint of each such window and each item. The fingerprints are cut
   into RADIUS + 1 blocks; two that differ in at most RADIUS bits agree in some block, so a
   join on item, block and value finds every pair within the radius.
3. The exact similarity of those pairs decides.

RADIUS lies where similarity 0.8 leaves next to nothing outside (0.8 means about 10 differing
bits, with a standard deviation of 3).

Defined results: words are folded to lower case from A to Z; an item of under 5 words is one
shingle of its own length; null and empty items match nothing, null and empty documents hold
nothing; a document shorter than the item is one window; items with equal texts are each
reported; repeated rows and null ids are reported as they stand; other columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import pick, renamed, text_key
from ledgersieve.sources.kept import kept

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
_SHARE = SIMILARITY / (1 + SIMILARITY)  # of both sides' shingles together


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+", -1), "")


def shingles(text: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words."""
    none = F.array().cast("array<bigint>")
    return _let(word_array(text), lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(1), F.size(w) - (width - 1)),
        lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))).otherwise(none))


def _items(items: DataFrame) -> DataFrame:
    """Distinct item texts with words: key, number of words, width and hashes of shingles."""
    sized = (pick(items, "text").select("text", text_key(F.col("text")).alias("__item"))
             .dropDuplicates(["__item"]).withColumn("__size", F.size(word_array(F.col("text"))))
             .where("__size > 0"))
    by_width = F.coalesce(*[F.when(F.least("__size", F.lit(SHINGLE)) == width,
                                   shingles(F.col("text"), width)) for width in range(1, SHINGLE + 1)])
    return kept(sized.select("__item", "__size", F.least("__size", F.lit(SHINGLE)).alias("__width"),
                             by_width.alias("__hashes")), "items")


def _bits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The SimHash of the hashes ``__hash`` of each group: bits set in over half of them."""
    sums = [F.sum(F.shiftright("__hash", b).bitwiseAND(1)).alias(f"__b{b}") for b in range(64)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *sums)
    mark = F.lit(0).cast("long")
    for b in range(64):
        bit = -(1 << 63) if b == 63 else 1 << b
        mark = mark.bitwiseOR(F.when(F.col(f"__b{b}") * 2 > F.col("__n"), F.lit(bit).cast("long"))
                              .otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "__n", mark.alias("__fp"))


def _blocks(marks: DataFrame) -> DataFrame:
    """One row for each block of a fingerprint: its number and its bits in place."""
    edges = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    masks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    return marks.select("*", F.posexplode(masks).alias("__block", "__mask")).withColumn(
        "__value", F.col("__fp").bitwiseAND(F.col("__mask"))).drop("__mask")


def _windows(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """Windows with enough anchors: __key, __item, __start and the hashes of their shingles."""
    items = items.where(F.col("__width") == width)
    parts = items.select("__item", "__size", F.explode(F.array_distinct("__hashes")).alias("__hash"))
    known = kept(parts.select("__hash").distinct(), "known")
    # the hashes are a bare column of the generator, so that they are computed once a row
    placed = (docs.select("__key", F.posexplode(shingles(F.col("text"), width)).alias("__at", "__hash"))
              .join(known, "__hash", "left_semi").distinct())
    anchors = placed.join(parts, "__hash").groupBy("__key", "__item", "__size").agg(
        F.sort_array(F.collect_list("__at")).alias("__at"))
    lengths = docs.select("__key", F.size(word_array(F.col("text"))).alias("__words"))
    anchors = kept(anchors, "anchors")
    sized = anchors.join(lengths.join(anchors, "__key", "left_semi").distinct(), "__key")
    whole = F.greatest(F.col("__words") - F.col("__size"), F.lit(0))  # the last place to begin
    count = F.least("__size", "__words") - (width - 1)  # shingles of a window
    least = F.ceil(F.lit(_SHARE) * (count + F.col("__size") - (width - 1)) - 1e-9).cast("int")
    firsts = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("__at") - 1),
                 lambda i: (F.get("__at", i) <= whole)
                 & (F.get("__at", i + least - 1) - F.get("__at", i) < count)),
        lambda i: F.get("__at", i))
    last = F.when(F.size(F.filter("__at", lambda p: p >= whole)) >= least, F.array(whole)).otherwise(
        F.array().cast("array<int>"))
    chosen = (sized.select("__key", "__item", count.alias("__count"),
                           F.explode(F.array_union(firsts, last)).alias("__start"))
              .groupBy("__key").agg(F.collect_list(F.struct("__item", "__start", "__count")).alias("__wins")))
    chosen = kept(chosen, "windows")
    cut = lambda hashes: F.transform("__wins", lambda w: F.struct(
        w["__item"].alias("__item"), w["__start"].alias("__start"),
        F.slice(hashes, w["__start"] + 1, w["__count"]).alias("__hashes")))
    return (docs.join(chosen, "__key")
            .select("__key", F.inline(_let(shingles(F.col("text"), width), cut)))
            .dropDuplicates(["__key", "__item", "__start"]))


def passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """__key, __item, __start, __size, __similarity: the best window of each text and item."""
    known = _items(items)
    widths = [r["__width"] for r in known.select("__width").distinct().collect()]  # at most 5
    found = None
    for width in sorted(widths):
        part = _windows(docs, known, width)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame(
            [], "__key long, __item long, __start int, __hashes array<bigint>")
    window = ["__key", "__item", "__start"]
    rows = kept(found.select(*window, F.explode("__hashes").alias("__hash")), "shingles")
    of_items = known.select("__item", "__size", F.explode("__hashes").alias("__hash"))
    item_marks = _blocks(_bits(of_items, ["__item", "__size"])).select(
        "__item", "__size", F.col("__n").alias("__own"), F.col("__fp").alias("__own_fp"),
        "__block", "__value")
    near = (_blocks(_bits(rows, window)).join(item_marks, ["__item", "__block", "__value"])
            .where(F.bit_count(F.col("__fp").bitwiseXOR(F.col("__own_fp"))) <= RADIUS)
            .select(*window, "__n", "__size", "__own").distinct())
    counts = rows.groupBy(*window, "__hash").agg(F.count("*").alias("__c"))
    owned = of_items.groupBy("__item", "__hash").agg(F.count("*").alias("__d"))
    shared = (counts.join(owned, ["__item", "__hash"]).groupBy(*window)
              .agg(F.sum(F.least("__c", "__d")).alias("__shared")))
    like = F.col("__shared") / (F.col("__n") + F.col("__own") - F.col("__shared"))
    best = (near.join(shared, window).withColumn("__like", like).where(F.col("__like") >= SIMILARITY)
            .groupBy("__key", "__item").agg(F.max(F.struct(
                "__like", (-F.col("__start")).alias("__back"), "__size")).alias("__best")))
    return best.select("__key", "__item", (-F.col("__best.__back")).alias("__start"),
                       F.col("__best.__size").alias("__size"), F.col("__best.__like").alias("__similarity"))


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, "text").select("text", text_key(F.col("text")).alias("__key"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity for every passage found."""
    found = kept(passages(_keyed(docs), items), "passages")
    names = pick(items, "item_id", "text").select("item_id", text_key(F.col("text")).alias("__item"))
    return (pick(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("__key"))
            .join(found.join(names, "__item"), "__key")
            .select("doc_id", "item_id", F.col("__start").alias("start_word"),
                    F.col("__size").alias("n_words"), F.col("__similarity").alias("similarity")))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark passage."""
    found = kept(passages(_keyed(docs), items).select("__key").distinct(), "leaks")
    own = renamed(docs)
    keyed = own.withColumn("__leak_key", text_key(F.col("text")))
    return keyed.join(found, keyed["__leak_key"] == found["__key"], "left_anti").select(*own.columns).toDF(*docs.columns)
