"""How far the sources of a language differ from each other and from the language as a whole.

Terms are runs of ASCII letters and of anything beyond ASCII, A-Z lower-cased. One
``bytes.translate`` lowers the letters and blanks every separator, ``bytes.split`` cuts, a
``Counter`` counts each document; tasks add those up for each language and source and hand on
sparse counts, so the shuffle carries a row for a term of a source, not for a word.

A language keeps the V terms that at least ``min_docs`` of its documents hold. In a group (a
source of a language, or the language) with N kept occurrences a term that occurs c times has
the share p = 1 + floor(SCALE * (c + 1) / (N + V)); two groups differ at it by
floor((p - q)^2 / q). All of it is exact integer arithmetic.

The sum over all kept terms of a pair of sources is not taken term by term. Let f(p, q) be the
difference and a0, b0 the shares of a term that does not occur. Then the sum is

    V f(a0, b0)
    + for each term of a:       f(pa, b0) - f(a0, b0)
    + for each term of b:       f(a0, pb) - f(a0, b0)
    + for each term of both:    f(pa, pb) - f(pa, b0) - f(a0, pb) + f(a0, b0)

The first three need only how often each share occurs in a source, which is a short list; the
last is added up by task before it is shuffled. The output holds every pair of sources of a
language, as asked, so it grows with the square of their number.

Odd rows: null text, language and source are ''. A group without terms is reported with its
pairs; a language without kept terms has pairs of value 0 and no terms. Every row is a document,
also if its id or text repeats. An empty table gives no rows. Other columns are ignored. A text
of any length is cut in stretches of about ``STRETCH`` bytes, at separators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve.llm.common import renamed
from ledgersieve.shipping import ship_package
from ledgersieve.sources.kept import kept

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20
#: A task adds up and hands on its counts of documents when it holds this many.
HELD_COUNTS = 1_000_000

#: Lowers A-Z, keeps a-z and every byte beyond ASCII, makes a blank of the rest.
TABLE = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32
    for byte in range(256))


def count_terms(text: bytes | None) -> Counter:
    """How often each term occurs in a text."""
    counts: Counter = Counter()
    lowered = (text or b"").translate(TABLE)
    at = 0
    while at < len(lowered):
        end = lowered.find(b" ", at + STRETCH)
        end = len(lowered) if end < 0 else end
        counts.update(lowered[at:end].split())
        at = end
    return counts


def _added_up(groups: list[tuple[str, str]], terms: list[bytes], counts: list[int],
              lengths: list[int], owners: list[int]) -> pa.RecordBatch:
    """Counts of documents as counts of groups: sorted by group and term, equal ones added."""
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    owner = np.repeat(np.array(owners, np.int64), lengths)
    cells, place = np.unique(owner * size + coded.indices.to_numpy(), return_inverse=True)
    n = np.zeros(len(cells), np.int64)
    np.add.at(n, place, np.array(counts, np.int64))
    docs = np.bincount(place, minlength=len(cells))
    # The groups themselves, under the term '', which no text holds
    own = np.concatenate([cells // size, np.arange(len(groups))])
    names = pa.concat_arrays([coded.dictionary.take(pa.array(cells % size)),
                              pa.array([b""] * len(groups), pa.binary())])
    zeros = np.zeros(len(groups), np.int64)
    langs, sources = (pa.array(x, pa.string()).take(pa.array(own)) for x in zip(*groups))
    return pa.RecordBatch.from_arrays(
        [langs, sources, names, pa.array(np.concatenate([docs, zeros]), pa.int64()),
         pa.array(np.concatenate([n, zeros]))], names=["lang", "source", "term", "docs", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, docs, n); the term '' stands for the group itself."""
    groups: dict[tuple[str, str], int] = {}
    terms, counts, lengths, owners = [], [], [], []
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for group, text in zip(zip(langs, sources), batch.column(2)):
            own = count_terms(text.as_py())
            terms.extend(own.keys())
            counts.extend(own.values())
            lengths.append(len(own))
            owners.append(groups.setdefault(group, len(groups)))
            if len(terms) >= HELD_COUNTS:
                yield _added_up(list(groups), terms, counts, lengths, owners)
                groups, terms, counts, lengths, owners = {}, [], [], [], []
    if groups:
        yield _added_up(list(groups), terms, counts, lengths, owners)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) of all texts, and a row with the term '' for each group."""
    ship_package(docs.sparkSession)
    named = renamed(docs, ("text", "lang", "source"))
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    parts = named.select(
        filled("lang").alias("lang"), filled("source").alias("source"),
        filled("text").cast("binary").alias("text"),
    ).mapInArrow(_sparse, "lang string, source string, term binary, docs long, n long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); null in a language without terms."""
    return F.expr(f"1 + cast({n} + 1 as decimal(19, 0)) * {SCALE} div nullif({total} + terms, 0)")


def _difference(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and terms a source overuses."""
    counts = kept(term_counts(docs), "term-counts")
    vocabulary = kept(
        counts.filter("term != ''").groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"),
            F.collect_list(F.struct("source", "n")).alias("held"))
        .filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    # One row for each source of a language: few, and joined by their measured size.
    of_lang = vocabulary.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n_lang").alias("lang_total"))
    of_group = vocabulary.select("lang", F.explode("held").alias("h")).groupBy(
        "lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
    groups = kept(
        counts.filter("term = ''").select("lang", "source")
        .join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
        .na.fill(0, ["total", "terms", "lang_total"])
        .withColumn("absent", _share("0", "total")), "groups")
    shares = (
        vocabulary.select("lang", "term", "n_lang", F.explode("held").alias("h"))
        .select("lang", "term", "n_lang", "h.*").join(groups, ["lang", "source"])
        .select("lang", "source", "term", _share("n", "total").alias("p"),
                _share("n_lang", "lang_total").alias("q"), "absent"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.filter("p > q").select("lang", "source", F.col("term").alias("item"),
                                      F.expr(_difference("p", "q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms))
    pairs = _pairs(groups, shares).withColumn("rank", F.row_number().over(by_value))
    return pairs.withColumn("part", F.lit("pair")).unionByName(
        terms.withColumn("part", F.lit("term"))
    ).select("lang", "source", "part", "item", "value", "rank")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language."""
    f = _difference
    others = groups.select(
        "lang", F.col("source").alias("item"), F.col("absent").alias("absent_there"))
    base = groups.join(others, "lang").filter("source != item").selectExpr(
        "lang", "source", "item", f"coalesce(terms * {f('absent', 'absent_there')}, 0) as value")
    often = shares.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("often"))
    alone = often.join(others, "lang").filter("source != item").selectExpr("lang", f"""inline(array(
        struct(source, item,
               often * ({f('p', 'absent_there')} - {f('absent', 'absent_there')}) as value),
        struct(item as source, source as item,
               often * ({f('absent_there', 'p')} - {f('absent_there', 'absent')}) as value)))""")
    held = shares.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "p", "absent")).alias("held"))
    both = (
        held.select("lang", "held", F.explode("held").alias("a"))
        .select("lang", "a", F.explode("held").alias("b")).filter("a.source != b.source")
        .selectExpr("lang", "a.source as source", "b.source as item",
                    f"{f('a.p', 'b.p')} - {f('a.p', 'b.absent')} - {f('a.absent', 'b.p')}"
                    f" + {f('a.absent', 'b.absent')} as value")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    return base.unionByName(alone).unionByName(both).groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"))


def sql() -> str:
    """The same rows for DuckDB: every kept term beside every pair, in 128-bit integers."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
word AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
vocabulary AS (
  SELECT lang, term, count(*) AS n FROM word GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCS}),
of_lang AS (SELECT lang, count(*) AS v, sum(n) AS n_all FROM vocabulary GROUP BY ALL),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM word SEMI JOIN vocabulary USING (lang, term)
  GROUP BY ALL),
totals AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts USING (lang, source)
  GROUP BY ALL),
share AS (
  SELECT t.lang, t.source, k.term, coalesce(c.c, 0) AS c,
    1 + {SCALE}::HUGEINT * (coalesce(c.c, 0) + 1) // (t.n + l.v) AS p,
    1 + {SCALE}::HUGEINT * (k.n + 1) // (l.n_all + l.v) AS q
  FROM totals t JOIN vocabulary k USING (lang) JOIN of_lang l USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM share WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place
  FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR place <= {TOP_TERMS}"""
