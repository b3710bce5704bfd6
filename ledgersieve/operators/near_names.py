"""Names that resemble each other: for each name the most similar one of a roster.

The score of a pair is the Ratcliff-Obershelp ratio 2 M / (a + b), where M letters stand in
matching blocks. M is at most the number of letters that the names share, and at most the length
of their longest common subsequence, so a pair that reaches the cutoff c passes both bounds.

1. A name is a set of tokens: each letter with its number among equal ones. All tokens are in one
   order, rarest in both tables together first.
2. Names of lengths n and m need o = c (n + m) / 2 common tokens, so the first n - o + 1 tokens
   of one and the first m - o + 1 of the other have one in common. They meet on that token and
   on the length m, which splits a frequent token by length, if enough tokens can follow it in
   both names; what meets carries no tokens, only names, places and 128 bits.
3. Common bits and the edit distance (at most n + m - 2 o) are tested first, then common tokens
   are counted.
4. The pairs of a name are scored in descending order of their bound, and no longer once the
   bound is below the best score; a pair whose longest common subsequence can't reach it is
   passed over, and so is one that could only equal it and has the smaller staff name. That is the
   only step in Python.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.shipping import ship_package
from ledgersieve.sources.kept import kept


def letter_tokens(name: Column) -> Column:
    """Each character with its number among equal ones: names share as many tokens as letters."""
    # in order of letters, the number is the distance from the first of its kind
    letters = F.transform(
        F.array(F.array_sort(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)))),
        lambda chars: F.transform(chars, lambda c, i: F.concat(
            c, (i + 2 - F.array_position(chars, c)).cast("string"))))
    return F.get(letters, F.lit(0))


def in_token_order(names: DataFrame, ranks: DataFrame) -> DataFrame:
    """(name, tokens, n, low, high, folded): the ranks of each name's tokens, rare ones first.

    ``low`` and ``high`` have a bit for each rank, modulo 128; ``folded`` counts the tokens that
    share a bit with another of the name. Names have at most as many tokens in common as bits,
    and ``folded`` more.
    """
    bit = lambda half: F.bit_or(F.when(
        F.col("rank") % 128 - half * 64 == F.col("rank") % 64,
        F.expr("shiftleft(1L, rank % 64)")).otherwise(F.lit(0).cast("long")))
    return (
        names.select("name", F.explode(letter_tokens(F.col("name"))).alias("token"))
        .join(ranks, "token").groupBy("name")
        .agg(F.sort_array(F.collect_list("rank")).alias("tokens"),
             bit(0).alias("low"), bit(1).alias("high"))
        .withColumn("n", F.size("tokens"))
        .withColumn("folded", F.expr("n - bit_count(low) - bit_count(high)")))


def token_ranks(names: DataFrame) -> DataFrame:
    """(token, rank): all tokens of the names, the rarest first.

    Ranked in one task, since there are only as many as letters, times the most that one name
    has of a letter.
    """
    counted = names.select(F.explode(letter_tokens(F.col("name"))).alias("token")).groupBy(
        "token").agg(F.count("*").alias("times"))
    return kept(counted.select(
        "token", F.row_number().over(Window.orderBy("times", "token")).alias("rank")), "token-ranks")


def candidate_pairs(names: DataFrame, staff: DataFrame, cutoff: float) -> DataFrame:
    """(name, staff, bound): every pair that can reach the cutoff, once, with its upper bound.

    Both tables have a column ``name`` of distinct names that aren't empty.
    """
    ranks = token_ranks(names.select("name").unionByName(staff.select("name")))
    asking = kept(in_token_order(names, ranks), "name-tokens")
    listed = kept(in_token_order(staff, ranks), "staff-tokens").select(
        F.col("name").alias("staff"), F.col("tokens").alias("staff_tokens"), F.col("n").alias("m"),
        F.col("low").alias("staff_low"), F.col("high").alias("staff_high"))
    need = f"cast(ceil({cutoff!r} * (n + m) / 2 - 1e-9) as int)"
    shortest = f"cast(ceil({{0}} * {cutoff / (2 - cutoff)!r} - 1e-9) as int)"
    longest = f"cast(floor({{0}} * {(2 - cutoff) / cutoff!r} + 1e-9) as int)"
    apart = f"cast(floor({1 - cutoff!r} * (n + m) + 1e-9) as int)"
    # Only lengths that a staff name has; there are no more of them than letters in the longest.
    lengths = kept(listed.select("m").distinct(), "staff-lengths")
    # A few megabytes of names are minutes of work, so they are dealt by name to all tasks; pairs that
    # meet on several tokens are then told apart within a task, before their edit distance is taken.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = asking.repartition(tasks, "name").selectExpr(
        "*", f"explode(sequence({shortest.format('n')}, {longest.format('n')})) as m"
    ).join(lengths, "m", "left_semi").selectExpr("name", "n", "m", "low", "high", "folded", f"posexplode(slice(tokens, 1, n - {need} + 1)) as (i, token)")
    # Against the shortest names the most tokens count; the others are filtered in the join.
    fewest = need.replace("n + m", f"{shortest.format('m')} + m")
    right = listed.selectExpr(
        "staff", "m", "staff_low", "staff_high", f"posexplode(slice(staff_tokens, 1, m - {fewest} + 1)) as (j, token)")
    met = (
        left.join(right, ["token", "m"])
        .filter(f"j <= m - {need} and 1 + least(n - 1 - i, m - 1 - j) >= {need}")
        .filter(f"bit_count(low & staff_low) + bit_count(high & staff_high) + folded >= {need}")
        .select("name", "staff", "n", "m").distinct()
        .filter(f"levenshtein(name, staff, {apart}) >= 0").select("name", "staff"))
    return (
        met.join(asking, "name").join(listed, "staff")
        .withColumn("common", F.size(F.array_intersect("tokens", "staff_tokens")))
        .filter(f"common >= {need}").selectExpr("name", "staff", "2D * common / (n + m) as bound"))


def letter_places(a: str) -> dict[str, int]:
    """For each letter the places where it stands, as bits of one integer."""
    at: dict[str, int] = {}
    for i, letter in enumerate(a):
        at[letter] = at.get(letter, 0) | 1 << i
    return at


def common_subsequence(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time in one integer.

    ``at`` has the letter places of ``a`` where they are known.
    """
    if at is None:
        at = letter_places(a)
    full = (1 << len(a)) - 1
    row = full
    for letter in b:
        hit = row & at.get(letter, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


class Best:
    """The best match of one name while its pairs come in descending order of their bounds."""

    def __init__(self, name: str, cutoff: float):
        self.name, self.score, self.staff, self.scored = name, cutoff, None, 0
        # what depends on the name alone is found once for all of its pairs
        self.at = letter_places(name)
        self.matcher = difflib.SequenceMatcher(None, "", name)

    def offer(self, staff: str, bound: float) -> None:
        """Equal scores go to the greater name, so a smaller one has to be better."""
        if bound < self.score or bound == self.score and self.after(staff):
            return
        most = 2.0 * common_subsequence(self.name, staff, self.at) / (len(staff) + len(self.name))
        if most < self.score or most == self.score and self.after(staff):
            return
        self.matcher.set_seq1(staff)
        score = self.matcher.ratio()
        self.scored += 1
        if score > self.score or score == self.score and (self.staff is None or staff > self.staff):
            self.score, self.staff = score, staff

    def after(self, staff: str) -> bool:
        return self.staff is not None and staff < self.staff

    def row(self) -> tuple:
        similarity = None if self.staff is None else ratio(self.name, self.staff)
        return self.name, self.staff, similarity, self.scored


def best_matches(pairs: DataFrame, cutoff: float) -> DataFrame:
    """(name, normalized_name, similarity, scored) for each name of the pairs.

    ``similarity`` is the ratio with the names exchanged, ``scored`` the number of pairs whose
    ratio was taken; no match is null. Pairs of a name are one sorted stretch of a partition and
    pass one by one.
    """
    ship_package(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: Best | None = None
        done: list[tuple] = []

        def rows() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.float64(), pa.int32())
            columns = list(zip(*done)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "name", "normalized_name", "similarity", "scored"])

        for batch in batches:
            for name, staff, bound in zip(*(column.to_pylist() for column in batch.columns)):
                if best is None or best.name != name:
                    if best is not None:
                        done.append(best.row())
                    best = Best(name, cutoff)
                best.offer(staff, bound)
            yield rows()
            done.clear()
        if best is not None:
            done.append(best.row())
            yield rows()

    return pairs.repartition("name").sortWithinPartitions("name", F.desc("bound"), F.desc("staff")).mapInArrow(
        run, "name string, normalized_name string, similarity double, scored int")


def closest_staff(names: DataFrame, roster: DataFrame, cutoff: float) -> DataFrame:
    """For each distinct ``name`` the most similar staff name at or above the cutoff."""
    if not 0 < cutoff <= 1:
        raise ValueError("The cutoff lies between 0 and 1.")
    staff = roster.select(F.col("normalized_name").alias("name")).filter(F.col("name") != "")
    pairs = candidate_pairs(names.filter(F.col("name") != ""), staff, cutoff)
    return best_matches(pairs, cutoff).filter("normalized_name is not null").drop("scored")
