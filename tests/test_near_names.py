import difflib
import random

import pytest
from pyspark.sql import functions as F

from ledgersieve.operators import near_names

SYLLABLES = "ma ne ra jo se ph ka ri to bi lu wa ngo shi te mb do ju li an".split()


def made(rng):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in "ab")


def test_few_pairs_are_scored_and_none_is_lost(spark):
    rng = random.Random(5)
    staff = sorted({made(rng) for _ in range(80)} | {"😀😃 tope", "n" * 60})
    names = {"😀😄 tope", "n" * 59 + "m", "n" * 50}
    while len(names) < 500:
        letters = list(made(rng) if rng.random() < 0.7 else rng.choice(staff))
        letters[rng.randrange(len(letters))] = rng.choice("aeiou")
        names.add("".join(letters))
    names -= set(staff)
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    pairs = near_names.candidate_pairs(frame(names), frame(staff), 0.75)
    found = {r["name"]: (r["normalized_name"], r["similarity"], r["scored"])
             for r in near_names.best_matches(pairs, 0.75).collect()}
    for name in names:
        match = difflib.get_close_matches(name, staff, n=1, cutoff=0.75)
        got = found.get(name, (None, None, 0))
        assert got[:2] == ((match[0], near_names.ratio(name, match[0])) if match else (None, None))
    assert sum(scored for *_, scored in found.values()) <= 10 * len(names)


def test_common_subsequence_bounds_the_matched_letters():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            above = row[:]
            for j, y in enumerate(b, 1):
                row[j] = above[j - 1] + 1 if x == y else max(above[j], row[j - 1])
        assert near_names.common_subsequence(a, b) == row[-1]
        assert near_names.ratio(a, b) <= 2.0 * row[-1] / (len(a) + len(b))


def test_tokens_number_equal_letters(spark):
    row = spark.range(1).select(near_names.letter_tokens(F.lit("abab 😀a😀")).alias("tokens")).first()
    assert sorted(row["tokens"]) == sorted(["a1", "a2", "a3", "b1", "b2", " 1", "😀1", "😀2"])


def test_names_meet_at_lengths_of_staff_only(spark):
    # one row for each of the 20 lengths that could reach the cutoff, and each token, met before
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    lengths = []
    with pytest.MonkeyPatch.context() as patch:
        plain = near_names.kept
        patch.setattr(near_names, "kept", lambda df, name: lengths.append((name, df)) or plain(df, name))
        pairs = near_names.candidate_pairs(
            frame([f"Customer#{i:09d}" for i in range(50, 90)]), frame(["Customer#000000001"]), 0.75)
    assert [[r["m"] for r in df.collect()] for name, df in lengths if name == "staff-lengths"] == [[18]]
    assert pairs.count() == 40


def test_a_name_is_prepared_once_for_all_its_pairs():
    rng = random.Random(2)
    for _ in range(50):
        name, *staff = ("".join(rng.choice("abc ") for _ in range(12)) for _ in range(20))
        best = near_names.Best(name, 0.5)
        for other in staff:
            best.offer(other, 1.0)
        match = difflib.get_close_matches(name, staff, n=1, cutoff=0.5)
        assert [best.staff] == (match or [None])


def test_equal_bounds_of_smaller_names_are_not_scored(spark):
    # numbered names share their letters; all pairs of equal bounds were scored before
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "name string")
    staff = [f"Customer#{i:09d}" for i in range(30)]
    names = [f"Customer#{i:09d}" for i in range(11_000, 11_060)]
    pairs = near_names.candidate_pairs(frame(names), frame(staff), 0.75)
    found = near_names.best_matches(pairs, 0.75).collect()
    assert {r["name"]: r["normalized_name"] for r in found} == {
        name: difflib.get_close_matches(name, staff, n=1, cutoff=0.75)[0] for name in names}
    assert sum(r["scored"] for r in found) <= 8 * len(names)
    assert pairs.count() == len(names) * len(staff)
