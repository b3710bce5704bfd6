import re
from collections import Counter

import numpy as np
import pytest

from ledgersieve.llm import boosted_rules, weak_quality
from ledgersieve.llm.statistics import NAMES, repeated_positions, statistics

from .conftest import ODD_TEXTS


def plain(text):
    """The rules' base counts, written as the contract words them."""
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(own, own[1:], own[2:]))
    covered = {i + k for i in range(len(own) - 2) if triples[tuple(own[i:i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered))


def test_statistics_follow_the_contract(sample):
    texts = [t for _, t in ODD_TEXTS] + [r.text for r in sample.select("text").collect()]
    texts += ["a b c\na b c\n\n a b c", "x\x0by\x0cz\r\nx", " a b a|b <>#"]
    for text in texts:
        assert statistics(text)[:5] == plain(text)


def test_repeated_positions_with_codes_too_large_for_one_number():
    codes = np.array([5, 2**40, 7, 5, 2**40, 7, 1])
    assert repeated_positions(codes) == 6


def test_weak_labels_find_quality_without_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = weak_quality.classify(docs).join(labels, "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in rows)
    clean = [r.kept for r in rows if r.quality]
    assert right / len(rows) > 0.97
    assert sum(clean) / len(clean) > 0.98


def test_estimate_trusts_labellers_that_agree():
    bad, good = [2] * 6 + [0] * 3, [1] * 9
    lone = [1] * 8 + [2]
    code = lambda votes: int("".join(map(str, votes)), 3)
    belief = weak_quality.estimate({code(bad): 200, code(good): 1000, code(lone): 30}, 40)
    assert belief[code(bad)] < 0.05 < 0.9 < belief[code(good)]


def test_weak_quality_of_odd_rows(odd_docs, no_docs):
    rows = weak_quality.classify(odd_docs).collect()
    assert len(rows) == len(ODD_TEXTS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add((r.score, r.kept))
    for empty in (4, 5, 6):
        assert by_id[empty] == {(0.0, False)}
    assert by_id[1] == by_id[2] and len(by_id[7]) == 1
    assert weak_quality.classify(no_docs).collect() == []
    kept = weak_quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert weak_quality.keep_good(no_docs).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return boosted_rules.judge(docs, labels).join(labels, "doc_id").toPandas()


def test_rules_follow_the_labels(judged):
    free = judged[~judged.base_failed]
    assert ((free.score >= 0.5) == (free.quality == 1)).mean() > 0.97
    assert not judged[judged.base_failed].kept.any()
    failed = (judged.n_words < 50) | (100 * judged.n_repeat_words > 50 * judged.n_words)
    assert (failed == judged.base_failed).all()


def test_rules_hold_out():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(boosted_rules.FEATURES)))
    y = (x[:, 0] + 0.3 * x[:, 7] < 0.6).astype(float)
    nodes = boosted_rules.fit(x[:2000], y[:2000], boosted_rules.RulesConfig())
    guess = boosted_rules.probability(x[2000:], nodes) > 0.5
    assert (guess == y[2000:]).mean() > 0.95


def test_scores_never_rise_with_a_falling_feature():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(boosted_rules.FEATURES)))
    y = (rng.random(600) < 0.3 + 0.4 * x[:, 0] * x[:, 8]).astype(float)  # rises in the noise
    nodes = boosted_rules.fit(x, y, boosted_rules.RulesConfig())
    for name in boosted_rules.FALLING:
        place = boosted_rules.FEATURES.index(name)
        grid = np.repeat(x[:50], 30, axis=0)
        grid[:, place] = np.tile(np.linspace(0, 1, 30), 50)
        score = boosted_rules.margin(grid, nodes).reshape(50, 30)
        assert (np.diff(score, axis=1) <= 1e-12).all()


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(boosted_rules.FEATURES)))
    nodes = boosted_rules.fit(x, (x[:, 9] > 0.4).astype(float), boosted_rules.RulesConfig(trees=7))

    def walk(row):
        total = float(nodes["base"])
        for at in nodes["roots"]:
            while nodes["left"][at] != at:
                at = nodes["left" if row[nodes["feature"][at]] <= nodes["cut"][at] else "right"][at]
            total += nodes["value"][at]
        return total

    assert np.allclose(boosted_rules.margin(x, nodes), [walk(r) for r in x])


def test_rules_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (3, None), (None, 1), (9, 0), (99, 1)], "doc_id long, quality int")
    rows = boosted_rules.contract(boosted_rules.judge(odd_docs, labels)).collect()
    assert len(rows) == len(ODD_TEXTS)
    texts = {}
    for i, t in ODD_TEXTS:
        texts.setdefault(i, set()).add(plain(t))
    for r in rows:
        assert tuple(r)[1:6] in texts[r.doc_id]
    nobody = labels.where("false")
    rows = boosted_rules.judge(odd_docs, nobody).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert boosted_rules.judge(no_docs, labels).collect() == []
    assert NAMES[:5] == ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
