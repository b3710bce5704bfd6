import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgersieve.llm import components, decontaminate, passages, simhash
from ledgersieve.llm.common import pick
from ledgersieve.sources import kept

from .conftest import ODD_TEXTS, prose


def own_words(text):
    return [w.lower() for w in (text or "").encode().split()]


def runs(words, width):
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def likeness(a, b):
    ours, theirs = Counter(a), Counter(b)
    both = sum((ours & theirs).values())
    return both / (len(a) + len(b) - both)


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def plain_fingerprint(text):
    words = own_words(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in runs(words, 4) or [tuple(words)]]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    marks = [plain_fingerprint(t) for _, t in rows]
    joined = Union()
    distinct = sorted(set(marks))
    for i, a in enumerate(distinct):
        for b in distinct[i:]:
            if (a ^ b).bit_count() <= 4:
                joined.join(a, b)
    least = {}
    for (doc, _), mark in zip(rows, marks):
        root = joined.find(mark)
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    return [(doc, f"{m:016x}", least.get(joined.find(m))) for (doc, _), m in zip(rows, marks)]


def near_copies(seed, groups, size):
    rnd, rows = random.Random(seed), []
    for group in range(groups):
        words = prose(seed + group, 150).split()
        for _ in range(size):
            copy = list(words)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = "other"
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def test_components_equal_a_plain_search(docs_of, sample):
    for rows in (near_copies(5, 12, 12) + [(1000 + i if i else i, t) for i, t in ODD_TEXTS],
                 [(r.doc_id, r.text) for r in sample.collect()]):
        got = [tuple(r) for r in simhash.components(docs_of(rows)).collect()]
        assert sorted(got, key=repr) == sorted(plain_components(rows), key=repr)


def test_crowded_cells_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 5)
    rnd = random.Random(3)
    marks = {0, -1}
    for _ in range(60):  # dense: all within a few bits of each other
        marks.add(sum(1 << b for b in rnd.sample(range(20), rnd.randint(1, 4))))
    frame = spark.createDataFrame([(m,) for m in marks], "__fp long")
    joined, plain = Union(), Union()
    for r in simhash.links(frame).collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 4
        joined.join(r.a, r.b)
    for a in marks:
        for b in marks:
            if ((a ^ b) % 2**64).bit_count() <= 4:
                plain.join(a, b)
    assert {m: joined.find(m) for m in marks} == {m: plain.find(m) for m in marks}


def test_count_vectors_bound_the_distance():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 4000), np.uint64)
    b[:2000] = a[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    manhattan = np.bitwise_count(simhash.count_vector(a) ^ simhash.count_vector(b))
    for x, y, m in zip(a[:50], b[:50], manhattan):
        counts = [abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)]
        assert sum(counts) == m
    assert (manhattan <= np.bitwise_count(a ^ b)).all()
    assert len(simhash.grid_masks()) == 70


def test_one_of_each_stays(docs_of, no_docs):
    rows = [(500 + i, t) for i, t in near_copies(9, 3, 4)] + ODD_TEXTS
    kept = simhash.keep_one_each(docs_of(rows))
    assert kept.columns == no_docs.columns
    left = Counter(r[0] for r in kept.collect())
    want = {c for _, _, c in plain_components(rows)}
    assert set(left) == want and max(left.values()) == 1
    assert simhash.keep_one_each(no_docs).count() == 0
    assert simhash.components(no_docs).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(80)] + [(7, 7), (60, 0)]
    edges += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    rnd.shuffle(edges)
    plain = Union()
    for a, b in edges:
        plain.join(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    for r in got.collect():
        assert r.label == plain.find(r.node)
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert {r.node for r in got.collect()} == ends
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_leaks(docs, items):
    out = {}
    for item, text in items:
        words = own_words(text)
        width = min(5, len(words))
        for doc, other in docs if words else []:
            there = runs(own_words(other), width)
            own, best = runs(words, width), 0
            for s in range(max(len(there) - len(own), 0) + 1):
                if there:
                    best = max(best, likeness(there[s:s + len(own)], own))
            if best >= 0.8:
                out[doc, item] = best
    return out


def test_leaks_equal_a_plain_search(spark, docs_of):
    rnd = random.Random(4)
    few = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(few) for _ in range(rnd.choice([1, 3, 5, 8, 20, 40, 60])))) for i in range(30)]
    items += [(100, None), (101, ""), (102, " "), (103, items[6][1]), (None, items[7][1])]
    docs = []
    for doc in range(150):
        words = [rnd.choice(few) for _ in range(rnd.randint(0, 80))]
        part = (rnd.choice(items[:30])[1]).split()
        for _ in range(rnd.randint(0, 2)):
            place = rnd.choice([0, len(part) - 1, rnd.randrange(len(part))])
            part[place:place + 1] = rnd.choice([["zz"], [part[place], "yy"]])
        at = rnd.randint(0, len(words))
        words[at:at] = part
        docs.append((doc, rnd.choice([" ", "\n", " \t "]).join(words).upper()))
    docs += [(800 + i, t) for i, t in ODD_TEXTS[3:7]] + [(900, items[6][1]), (900, items[6][1]), (None, "x " + items[6][1])]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, similarity string")
    found = decontaminate.contaminated(docs_of(docs), table).collect()
    want = plain_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in found} == set(want)
    for r in found:
        assert r.similarity == pytest.approx(want[r.doc_id, r.item_id])
    assert sum(r.doc_id == 900 and r.item_id == 6 for r in found) == 2
    kept = decontaminate.keep_clean(docs_of(docs), table)
    dirty = {d for d, _ in want}
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0] is not None) == sorted(
        d for d, _ in docs if d is not None and d not in dirty)


def test_no_items_and_no_documents(spark, docs_of, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontaminate.contaminated(docs_of(ODD_TEXTS), none).collect() == []
    assert decontaminate.contaminated(no_docs, some).collect() == []
    assert decontaminate.keep_clean(docs_of(ODD_TEXTS), none).count() == len(ODD_TEXTS)


def test_compact_windows_cover_every_run():
    rnd = random.Random(1)
    few = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(few) for _ in range(n)) for n in (0, 3, 49, 50, 51, 120, 300)]
    values, begins = passages.shingle_values([*texts, None])
    assert begins[-1] == sum(len(t.split()) for t in texts)
    for function in range(passages.FUNCTIONS):
        centre, left, right, _ = passages.compact_windows(values, function)
        for start in range(len(values) - passages.LEAST + 1):
            run = values[start:start + passages.LEAST]
            inside = (centre - left <= start) & (centre + right >= start + passages.LEAST - 1) \
                & (centre >= start) & (centre < start + passages.LEAST)
            assert inside.sum() == (run > 0).all()


def test_tiny_batches_have_shingles():
    for texts in (["a"], ["a b c d"], ["a b c d e"], [None, "", "x"]):
        values, begins = passages.shingle_values(texts)
        assert len(values) == begins[-1]
        assert (values > 0).sum() == sum(max(len((t or "").split()) - 4, 0) for t in texts)


def regions_of(*texts):
    return [v[v > 0] for v in (passages.shingle_values([t])[0] for t in texts)]


def plain_passage(ours, theirs):
    """Whether a range of each, from and to equal shingles, is alike: every range is tried."""
    for a in range(len(ours)):
        for b in np.flatnonzero(theirs == ours[a]):
            for n in range(passages.LEAST, len(ours) - a + 1):
                for m in np.flatnonzero(theirs[b:] == ours[a + n - 1]) + 1:
                    if m >= passages.LEAST and passages._likeness(ours[a:a + n], theirs[b:b + m]) >= 0.8:
                        return True
    return False


@pytest.mark.parametrize("size", [56, 60, 90])
def test_edits_of_several_words_are_verified(size):
    rnd, found = random.Random(size), 0
    for case in range(24):
        words = prose(7000 + size, size).split()
        other, at = list(words), rnd.randint(5, size - 7)
        if case % 4 == 0:
            other[at:at + 2] = ["changed", "words"]
        elif case % 4 == 1:
            other[at:at] = ["two", "added"]
        elif case % 4 == 2:
            del other[at:at + 2]
        else:
            other[at:at + 3] = ["three", "changed", "words"]
        both = regions_of(*[" ".join([prose(c + case, 30), *w, prose(c + 50 + case, 30)])
                            for c, w in ((1, words), (200, other))])
        told = passages.agree(*both)
        assert bool(told) == plain_passage(*both)
        found += len(told)
        assert all(n >= passages.LEAST <= m and like >= 0.8
                   and passages._likeness(both[0][a:a + n], both[1][b:b + m]) == like
                   for a, n, b, m, like in told)
    assert found >= (6 if size < 90 else 24)


@pytest.mark.parametrize("between", [0, 2, 7, 12, 20, 40, 60, 90])
def test_passages_side_by_side_are_all_told(between):
    first, second = prose(41, 60), prose(42, 60)
    for parts in ((first, second), (second, first), (first, second, first)):
        ours, theirs = regions_of(" ".join((prose(43, 20), first, second, prose(44, 20))),
                                  prose(45, between + 1).join(f" {p} " for p in parts))
        told = passages.agree(ours, theirs)
        covered = {x for a, n, *_ in told for x in range(a, a + n)}
        assert covered >= {*range(20, 76), *range(80, 136)}
        assert sum(n for _, n, *_ in told) == len(covered)
        assert passages.agree(theirs, ours)


def test_planted_passages_are_found_and_verified(docs_of):
    rnd = random.Random(8)
    shared = [prose(1000 + i, n) for i, n in enumerate((51, 55, 70, 200))]
    rows, planted = [], set()
    for doc in range(60):
        words = prose(5000 + doc, rnd.randint(60, 300)).split()
        if doc % 2:
            part = shared[doc // 2 % 4].split()
            at = rnd.randint(0, len(words))
            words[at:at] = part
            planted.add(doc)
        rows.append((doc, " ".join(words)))
    near = shared[3].split()
    near[100] = "changed"
    rows += [(70, prose(70, 100) + " " + " ".join(near))]
    planted.add(70)
    rows += [(80, rows[0][1]), (81, rows[0][1].upper())] + [(200 + (i or 0), t) for i, t in ODD_TEXTS[3:10]]
    rows += [(90, prose(90, 49)), (91, prose(90, 49) + " " + prose(91, 60))]
    found = passages.repeats(docs_of(rows)).collect()
    texts = dict(rows)
    for r in found:
        a = own_words(texts[r.doc_id])[r.first_word:r.first_word + r.n_words]
        b = own_words(texts[r.source_doc_id])[r.source_first_word:r.source_first_word + r.source_n_words]
        assert min(len(a), len(b)) >= 50
        assert likeness(runs(a, 5), runs(b, 5)) == pytest.approx(r.similarity)
        assert r.similarity >= 0.8
    named = {r.doc_id for r in found} | {r.source_doc_id for r in found}
    assert named == planted | {0, 80, 81}


def test_near_passages_of_the_shortest_kind_are_all_found(docs_of):
    rows = []
    for case in range(200):
        words = prose(20_000 + case, 51).split()
        other = list(words)
        other[20 + case % 10] = "changed"
        rows += [(2 * case, " ".join((prose(30_000 + case, 20), *words, prose(40_000 + case, 20)))),
                 (2 * case + 1, " ".join((prose(50_000 + case, 20), *other, prose(60_000 + case, 20))))]
    found = passages.repeats(docs_of(rows)).collect()
    assert {tuple(sorted((r.doc_id, r.source_doc_id))) for r in found} == {(i, i + 1) for i in range(0, 400, 2)}


def test_members_that_a_leader_fails_are_compared(docs_of):
    rows, pairs = [], set()
    for case in range(60):
        line, rest = prose(70_000 + case, 40), prose(71_000 + case, 11)
        rows += [(10 * case + i, " ".join((prose(72_000 + 10 * case + i, 30), line, rest if i < 2 else "",
                                           prose(73_000 + 10 * case + i, 30)))) for i in range(6)]
        pairs.add((10 * case, 10 * case + 1))
    found = passages.repeats(docs_of(rows)).collect()
    assert {tuple(sorted((r.doc_id, r.source_doc_id))) for r in found} == pairs


def test_every_place_of_a_leader_is_compared(docs_of):
    rows, pairs = [], set()
    for case in range(40):
        line, rest = prose(80_000 + case, 40), prose(81_000 + case, 20).split()
        near = list(rest)
        near[10] = "changed"
        rows += [(10 * case, " ".join((prose(82_000 + case, 30), line, prose(83_000 + case, 200), line, *rest))),
                 (10 * case + 1, " ".join((prose(84_000 + case, 30), line, *near, prose(85_000 + case, 9)))),
                 (10 * case + 2, " ".join((line, prose(86_000 + case, 300), line, *rest)))]
        pairs |= {10 * case, 10 * case + 1, 10 * case + 2}
    found = passages.repeats(docs_of(rows)).collect()
    assert {r.doc_id for r in found} | {r.source_doc_id for r in found} == pairs


def test_tables_that_no_later_step_reads_are_deleted(docs_of, spark):
    passage = prose(90_001, 80)
    docs = docs_of([(i, f"{prose(90_002 + i, 30)} {passage} {prose(90_012 + i, 30)}") for i in range(4)])
    with kept.scope(spark) as folder:
        found = passages.repeats(docs).collect()
        left = {name.rsplit("-", 1)[0] for name in os.listdir(folder.removeprefix("file:"))}
    assert {r.doc_id for r in found} | {r.source_doc_id for r in found} == {0, 1, 2, 3}
    assert left == {"texts", "asked-runs", "passages", "run-passages", "all-passages", "members", "classes"}


def test_shingles_of_a_text_do_not_depend_on_those_before():
    rng = random.Random(11)
    texts = ["".join(rng.choice("aAzZ\u00c4\u3000\x1c\x85 \t\n\x0b") for _ in range(200)) for _ in range(40)]
    texts = [t for _, t in ODD_TEXTS] + texts
    values, begins = passages.shingle_values(pa.array(texts))
    known = {}
    for text, a, b in zip(texts, begins, begins[1:]):
        shingles = runs(own_words(text), 5)
        assert len(own_words(text)) == b - a and (values[a + len(shingles):b] == 0).all()
        assert all(known.setdefault(shingle, value) == value for shingle, value in zip(shingles, values[a:b]))
    assert len(set(known.values())) == len(known)


def test_passages_of_odd_rows(docs_of, no_docs):
    rows = passages.repeats(docs_of(ODD_TEXTS)).collect()
    assert Counter((r.doc_id, r.source_doc_id) for r in rows if r.similarity == 1 and r.n_words == 120) \
        == Counter([(2, 1), (None, 1)])
    assert {r.doc_id for r in rows} | {r.source_doc_id for r in rows} == {None, 1, 2, 3}
    assert passages.repeats(no_docs).collect() == []


def test_chains_of_stretches_and_of_places_are_worth_the_same():
    rng = np.random.default_rng(5)
    for _ in range(60):
        ours = rng.integers(1, rng.integers(5, 90), 120).astype(np.uint64)
        theirs = np.where(rng.random(120) < 0.8, ours, rng.integers(1, 90, 120)).astype(np.uint64)
        here, there = np.nonzero(ours[:, None] == theirs[None, :])
        for price in (10, 1):
            worth = []
            for chain in (passages._chains(*passages._stretches(here, there), price),
                          passages._chains_by_place(here, there, price)):
                a, b = next(chain)
                worth.append(20 * len(a) - price * (a[-1] - a[0] + b[-1] - b[0] + 2 - 2 * len(a)))
            assert worth[0] == worth[1]


def test_ties_of_a_line_said_over_and_over_grow_with_the_texts(docs_of):
    line = " ".join(f"w{i}" for i in range(60))
    counts = []
    for times in (20, 200):
        rows = [(n, " ".join([*[line] * times, f"end{n}"])) for n in (1, 2)]
        keyed = pick(docs_of(rows), "doc_id", "text").withColumnRenamed("doc_id", "__key")
        shared = passages._shared(passages.windows(keyed, passages.opened(keyed)), "shared")
        counts.append(passages._star(shared).count())
    assert counts[1] < 12 * counts[0]


def test_ranges_without_enough_hits_hold_no_passage():
    rng = np.random.default_rng(6)
    for share in (0.7, 0.8, 0.85):
        for _ in range(40):
            hit = rng.random(130) < share
            plain = any(5 * hit[a:b].sum() >= 4 * (b - a)
                        for a in range(131) for b in range(a + passages.LEAST, 131))
            assert passages._dense(hit) == plain


def test_chains_of_any_number_of_pairs_are_those_of_places(monkeypatch):
    rng = np.random.default_rng(7)
    for case in range(60):
        monkeypatch.setattr(passages, "PAIRS", (10, 200, 10_000)[case % 3])
        ours = rng.integers(1, rng.integers(3, 60), 150).astype(np.uint64)
        theirs = np.where(rng.random(150) < 0.8, ours, rng.integers(1, 60, 150)).astype(np.uint64)
        theirs = theirs[:rng.integers(90, 151)]
        pairs = passages._Listed(ours, theirs)
        here, there = np.nonzero(ours[:, None] == theirs[None, :])
        assert all(np.array_equal(*x) for x in zip(pairs.all(), (here, there), strict=True))
        for price in (10, 1):
            told = [sorted((a.tolist(), b.tolist()) for a, b in chains) for chains in (
                passages._chains_listed(pairs, price), passages._chains_by_place(here, there, price))]
            assert told[0] == told[1]


def test_passages_among_words_said_very_often_are_found():
    # over 5,000,000 pairs of equal shingles: the range was given up before
    rng = np.random.default_rng(8)
    line = rng.integers(1, 1 << 40, 4).astype(np.uint64)
    same = rng.integers(1, 1 << 40, 80).astype(np.uint64)
    near = same.copy()
    near[40:44] += np.uint64(1)
    often = lambda n: np.tile(line, n)
    noise = lambda: rng.integers(1 << 41, 1 << 42, 30).astype(np.uint64)
    ours = np.concatenate([often(1250), noise(), same, noise(), often(10)])
    theirs = np.concatenate([often(10), noise(), near, noise(), often(1250)])
    assert passages._Listed(ours, theirs).total > passages.PAIRS
    found = passages._aligned(ours, theirs)
    assert any(a <= 5030 and a + n >= 5110 and b <= 70 and b + m >= 150 for a, n, b, m in found)
    assert any(n >= 4_990 and m >= 4_990 for _, n, _, m in found)


def test_few_values_are_told_as_isin_tells_them():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 80):
        a, b = (rng.integers(0, 60, n).astype(np.uint64) for n in (70, size))
        assert (passages._held(a, b) == np.isin(a, b)).all() and (passages._held(b, a) == np.isin(b, a)).all()


def plain_ties(rows):
    """(sign, key, own place, lead, lead place, more) of shared signatures, text by text."""
    out = []
    for sign in {r[0] for r in rows}:
        texts = {}
        for _, key, at in sorted(r for r in rows if r[0] == sign):
            texts.setdefault(key, []).append(at)
        lead = min(texts)
        if len(texts) > 1:
            out += [(sign, lead, at, lead, at, False) for at in texts.pop(lead)]
            theirs = [r[4] for r in out if r[:2] == (sign, lead)]
            for key, own in texts.items():
                out += [(sign, key, own[min(i, len(own) - 1)], lead, theirs[min(i, len(theirs) - 1)], i >= len(own))
                        for i in range(max(len(own), len(theirs)))]
    return sorted(out)


def test_ties_equal_plain_ones_wherever_batches_end(monkeypatch):
    rng = np.random.default_rng(14)
    schema = ["__sign", "__key", "__at", "__reach"]
    for case in range(30):
        monkeypatch.setattr(passages, "TIES", (1, 7, 1000)[case % 3])
        rows = list({(int(s), int(k), int(a)) for s, k, a in zip(
            rng.integers(0, 1 + case, 200), rng.integers(0, (2, 5, 40)[case % 3], 200), rng.integers(0, 500, 200))})
        rows += [(99, 7, 1), (99, 7, 2)]

        def batches(lines, size):
            for i in range(0, len(lines), size):
                columns = list(zip(*lines[i:i + size], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema)

        size = (1, 3, 64, 1000)[case % 4]
        by_sign = sorted(((*r, 0) for r in rows), key=lambda r: r[0])
        met = [tuple(r.values()) for b in passages._several(batches(by_sign, size), 1 + 2 * (case % 2))
               for r in b.to_pylist()]
        several = {s for s, *_ in rows if len({k for t, k, _ in rows if t == s}) > 1}
        assert sorted(met) == sorted(r for r in by_sign if r[0] in several)
        # the signatures of one text have no ties either where they are still there
        told = [tuple(r.values()) for b in passages._ties(batches(sorted(by_sign if case % 2 else met), size))
                for r in b.to_pylist()]
        assert sorted((s, k, at, lead, there, more) for s, k, at, _, lead, there, _, more in told) == plain_ties(rows)


def test_windows_beside_their_leaders_are_sent_once(docs_of):
    passage = prose(95_001, 80)
    docs = docs_of([(i, f"{prose(95_002 + i, 30)} {passage} {prose(95_012 + i, 30)}") for i in range(4)])
    keyed = pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "__key")
    tied = passages._star(passages._shared(passages.windows(keyed, passages.opened(keyed)), "shared"))
    assert "Exchange" not in tied._jdf.queryExecution().executedPlan().toString()
    # windows at the edges of the passage may have leaders of their own
    assert {(r["__key"], r["__lead"]) for r in tied.collect()} >= {(1, 0), (2, 0), (3, 0)}


def test_regions_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(15)
    for _ in range(20):
        n = 300
        pair = np.sort(rng.integers(0, 12, n))
        at, slope = rng.integers(50, 900, n), rng.integers(-40, 40, n)
        reach, lead_reach = (64 * rng.integers(0, 46, n) + rng.integers(0, 46, n) for _ in range(2))
        function = rng.choice([0, 1, 2, 11, passages.ALL], n, p=[0.4, 0.3, 0.1, 0.1, 0.1])
        low = at - np.minimum(reach // 64, lead_reach // 64)
        high = at + np.minimum(reach % 64, lead_reach % 64)
        plain = []
        for p in range(12):
            rows = sorted(np.flatnonzero(pair == p).tolist(), key=lambda i: slope[i])
            groups = []
            for i in rows:
                if not groups or slope[i] - slope[groups[-1][-1]] > passages.DRIFT:
                    groups.append([])
                groups[-1].append(i)
            for group in groups:
                parts = []
                for i in sorted(group, key=lambda i: low[i]):
                    if not parts or low[i] > max(high[parts[-1]]) + passages.DRIFT:
                        parts.append([])
                    parts[-1].append(i)
                plain += [(p, min(low[x]), max(high[x]), min(low[x]) - max(slope[x]), max(high[x]) - min(slope[x]))
                          for x in parts if len(set(function[x])) >= passages.ENOUGH or passages.ALL in function[x]]
        found = passages.meetings(pair, at, reach, at - slope, lead_reach, function)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(plain)


def test_numbered_shingles_are_as_alike_as_before():
    rng = np.random.default_rng(16)
    for size in (5, 60, 3000):
        a, b = (rng.integers(0, 50, n).astype(np.uint64) << np.uint64(50) for n in (size, 40))
        ours, theirs, numbers = passages._numbered(a, b)
        assert numbers == len(np.unique(np.concatenate((a, b))))
        assert (passages._among(ours, theirs, numbers) == np.isin(a, b)).all()
        for many in (numbers, 1 << 20):
            assert passages._alike(ours, theirs, many) == passages._likeness(a, b)
