"""Personal data in whole texts, found with SQL functions only.

Regular expressions propose spans; checks on the digits (Luhn for cards, mod 97 for account
numbers, ranges and lengths) confirm them; words near a span raise the score of kinds whose
pattern alone says little. The four base kinds are reported whenever pattern and check hold.

The patterns match what the contract's patterns match, in a form whose time doesn't grow with
the square of a long run and which never recurses: quantified groups are possessive where
nothing after them could make them give back, and a match starts at the beginning of a run
of its first characters or where the last match ended.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated
results; a null doc_id stays null; other columns are ignored, whatever their names; an empty
table gives an empty result. Very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve.llm.common import pick, renamed

# Kinds in the order they are listed, the base ones first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
THRESHOLD = 0.6
NEAR = 40
_BLOCK = 128


@dataclass(frozen=True)
class Kind:
    """A pattern, a word its texts must hold, its score and the words that raise it."""
    pattern: str
    needs: str
    score: float
    context: str = "(?!)"


KINDS = {
    "email": Kind(r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
                  "@", 0.9, "mail|contact"),
    "ip": Kind(r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+", ".", 0.7, "address|host|server"),
    "card": Kind(r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit"),
    "phone": Kind(r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobile"),
    "iban": Kind(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
                 "", 0.6, "iban|account"),
    "ssn": Kind(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social security"),
    "local_phone": Kind(r"(?<![0-9(+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
                        "", 0.3, "phone|call|tel|mobile|fax"),
}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(steps: Column) -> Column:
    """Running sums of an array, block by block so that long arrays stay cheap."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    in_blocks = lambda steps: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    in_order = lambda blocks, totals: F.flatten(F.transform(blocks, lambda part, b: _let(
        total(F.slice(totals, F.lit(1), b)), lambda before: F.transform(
            part, lambda _, i: before + total(F.slice(part, F.lit(1), i + 1))))))
    return _let(steps, lambda s: _let(in_blocks(s), lambda blocks: _let(
        F.transform(blocks, total), lambda totals: in_order(blocks, totals))))


def _matches(text: Column, pattern: str) -> Column:
    """Matches as (start, end, word): starts are what stood before them, added up."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = lambda hits: F.transform(hits, F.length)
    steps = lambda gaps, sizes: F.transform(sizes, lambda _, i: F.get(gaps, i) + F.when(
        i > 0, F.get(sizes, i - 1)).otherwise(0))
    placed = lambda hits: _let(gaps, lambda g: _let(sizes(hits), lambda n: F.zip_with(
        _running(steps(g, n)), hits, lambda start, hit: F.struct(
            start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("word")))))
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    return _let(hits, lambda h: F.when(F.size(h) > 0, placed(h)).otherwise(none))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(word: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0."""
    total = lambda digits: F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda a, i: a + _let(_at(digits, i), lambda d: F.when(i % 2 == 1, d).otherwise(
            2 * d - F.when(d > 4, 9).otherwise(0))))
    return _let(F.reverse(_digits(word)), lambda digits: F.when(
        F.length(digits).between(13, 19), total(digits) % 10 == 0).otherwise(False))


def _at(digits: Column, place: Column) -> Column:
    return F.ascii(F.substring(digits, place, F.lit(1))) - 48


def mod_97(word: Column) -> Column:
    """15 to 34 characters whose number, country and check digits moved to the end, leaves 1."""
    turned = lambda plain: F.concat(
        F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    rest = lambda turned: F.aggregate(
        F.sequence(F.lit(1), F.length(turned)), F.lit(0),
        lambda a, i: _let(_at(turned, i), lambda d: F.when(d < 10, (a * 10 + d) % 97)
                          .otherwise((a * 100 + d - 7) % 97)))
    return _let(F.replace(word, F.lit(" "), F.lit("")), lambda plain: F.when(
        F.length(plain).between(15, 34), _let(turned(plain), rest) == 1).otherwise(False))


def _confirmed(kind: str, word: Column) -> Column:
    if kind == "ip":
        parts = F.split(word, r"\.")
        short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return luhn(word)
    if kind == "phone":
        return F.length(_digits(word)).between(9, 15)
    if kind == "iban":
        return mod_97(word)
    if kind == "ssn":
        return ~word.substr(1, 3).isin("000", "666") & (word.substr(1, 1) != "9") \
            & (word.substr(5, 2) != "00") & (word.substr(8, 4) != "0000")
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """All confirmed spans of one kind: an array of (kind, start, end, score)."""
    rule = KINDS[kind]
    score = lambda m: F.lit(rule.score) + F.when(
        F.rlike(F.lower(F.substring(text, F.greatest(m["start"] - NEAR, F.lit(0)) + 1,
                                    F.least(m["start"], F.lit(NEAR)))), F.lit(rule.context)),
        0.4).otherwise(0.0)
    spans = F.transform(
        F.filter(_matches(text, rule.pattern), lambda m: _confirmed(kind, m["word"])),
        lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"),
                           m["end"].alias("end"), score(m).alias("score")))
    needed = F.contains(text, F.lit(rule.needs)) & F.rlike(text, F.lit("@" if kind == "email" else "[0-9]"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    sure = spans if kind in BASE else F.filter(spans, lambda m: m["score"] >= THRESHOLD)
    return F.when(needed, sure).otherwise(none)


def with_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, an array of spans for each base kind, and of the added ones.

    A span of an added kind that overlaps a base span, or one of an added kind listed before
    it, is left out.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__text"))
    text = F.col("__text")
    rows = rows.withColumns({f"__{kind}": found(text, kind) for kind in KINDS})
    seen = F.concat(*[F.col(f"__{kind}") for kind in BASE])
    for kind in ADDED:
        free = _let(seen, lambda taken: F.filter(
            F.col(f"__{kind}"), lambda m: ~F.exists(
                taken, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))))
        rows = rows.withColumn(f"__{kind}", F.when(F.size(f"__{kind}") > 0, free).otherwise(
            F.col(f"__{kind}")))
        seen = F.concat(seen, F.col(f"__{kind}"))
    return rows


def _written(kinds: tuple[str, ...]) -> Column:
    spans = F.concat(*[F.col(f"__{kind}") for kind in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of their spans, and all spans, for each row."""
    rows = with_spans(pick(docs, "doc_id", "text"), ["doc_id"])
    counts = [F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select("doc_id", *counts, F.sha2(_written(BASE), 256).alias("base_sha256"),
                       _written(BASE + ADDED).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; null texts stay null.

    Of spans that overlap, the first is replaced and what the others reach beyond it goes
    with it. A column named n_chars is set to the new length.
    """
    own = renamed(docs, ("doc_id", "text", "n_chars"))
    rows = with_spans(own, list(own.columns))
    text = F.col("__text")
    spans = F.array_sort(F.transform(
        F.concat(*[F.col(f"__{kind}") for kind in KINDS]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("out"))
    walk = lambda spans: F.aggregate(spans, first, lambda a, s: F.struct(
        F.greatest(a["to"], s["end"]).alias("to"),
        F.when(s["start"] >= a["to"], F.concat(a["out"], F.array(
            F.substring(text, a["to"] + 1, s["start"] - a["to"]),
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["out"]).alias("out")))
    clean = _let(_let(spans, walk), lambda w: F.concat(
        F.array_join(w["out"], ""), F.substring(text, w["to"] + 1, F.length(text))))
    masked = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(
        F.size(spans) == 0, F.col("text")).otherwise(clean)
    out = rows.withColumn("__masked", masked)
    kinds = dict(own.dtypes)
    made = {"text": F.col("__masked")}
    if "n_chars" in kinds:
        made["n_chars"] = F.length("__masked").cast(kinds["n_chars"])
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in own.columns]
                      ).toDF(*docs.columns)
