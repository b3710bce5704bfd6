"""The personal-data query in DuckDB SQL, written from the contract, not from the operator."""

from __future__ import annotations

# Fixed values of the contract, then the added kinds; this engine's patterns know no
# lookaround, so what stands beside a match is tested afterwards.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
}
NEEDS = {"email": "contains(text, '@')", "phone": "contains(text, '+')"}
BASE = ("email", "ip", "card", "phone")

DIGITS = "regexp_replace(m.word, '[^0-9]', '', 'g')"
PLAIN = "replace(m.word, ' ', '')"
BEFORE = "text[m.a:m.a]"  # 1-based: the character before the match
AFTER = "text[m.b + 1:m.b + 1]"
NEAR = "lower(text[greatest(m.a - 40, 0) + 1:m.a])"

LUHN = f"""length({DIGITS}) between 13 and 19 and list_sum(list_transform(
  range(1, length({DIGITS}) + 1), lambda i: case when i % 2 = 1
    then cast(reverse({DIGITS})[i] as integer)
    else 2 * cast(reverse({DIGITS})[i] as integer)
      - case when cast(reverse({DIGITS})[i] as integer) > 4 then 9 else 0 end end)) % 10 = 0"""

MOD_97 = f"""length({PLAIN}) between 15 and 34 and list_reduce(list_prepend(0, list_transform(
  range(1, length({PLAIN}) + 1), lambda i: ascii(({PLAIN}[5:] || {PLAIN}[1:4])[i]))),
  lambda a, c: case when c < 58 then (a * 10 + c - 48) % 97 else (a * 100 + c - 55) % 97 end) = 1"""

SURE = {
    "email": "true",
    "ip": """list_bool_and(list_transform(string_split(m.word, '.'), lambda p:
      length(ltrim(p, '0')) <= 3 and cast('0' || ltrim(p, '0')[1:4] as integer) <= 255))""",
    "card": LUHN,
    "phone": f"length({DIGITS}) between 9 and 15",
    "iban": f"""not regexp_matches({BEFORE}, '[A-Za-z0-9]') and not regexp_matches({AFTER}, '[A-Za-z0-9]')
      and {MOD_97}""",
    "ssn": f"""not regexp_matches({BEFORE}, '[0-9-]') and not regexp_matches({AFTER}, '[0-9-]')
      and m.word[1:3] not in ('000', '666') and m.word[1] <> '9' and m.word[5:6] <> '00'
      and m.word[8:] <> '0000' and regexp_matches({NEAR}, 'ssn|social security')""",
    "local_phone": f"""not regexp_matches({BEFORE}, '[0-9(+-]') and not regexp_matches({AFTER}, '[0-9-]')
      and regexp_matches({NEAR}, 'phone|call|tel|mobile|fax')""",
}


def _matches(kind: str) -> str:
    pattern = PATTERNS[kind]
    needed = NEEDS.get(kind, "regexp_matches(text, '[0-9]')")
    return f"""case when {needed} then list_filter(list_transform(
    range(1, len(regexp_extract_all(text, '{pattern}')) + 1), lambda k: {{
      'word': regexp_extract_all(text, '{pattern}')[k],
      'a': cast(list_sum(list_transform(string_split_regex(text, '{pattern}')[1:k], lambda g: length(g)))
        + coalesce(list_sum(list_transform(regexp_extract_all(text, '{pattern}')[1:k - 1],
            lambda h: length(h))), 0) as bigint),
      'b': cast(list_sum(list_transform(string_split_regex(text, '{pattern}')[1:k], lambda g: length(g)))
        + list_sum(list_transform(regexp_extract_all(text, '{pattern}')[1:k], lambda h: length(h))) as bigint)
    }}), lambda m: {SURE[kind]}) else [] end as {kind}"""


def _written(kinds) -> str:
    return " || ".join(["array_to_string(list_concat(" + ", ".join(
        f"list_transform({kind}, lambda s: '{kind}:' || s.a || ':' || s.b)" for kind in kinds) + "), ',')"])


def sql() -> str:
    steps = ["texts as (select doc_id, coalesce(text, '') as text from documents)",
             "spans as (select doc_id, text, " + ",\n".join(_matches(k) for k in PATTERNS) + " from texts)"]
    last, taken = "spans", list(BASE)
    for kind in list(PATTERNS)[len(BASE):]:
        seen = "list_concat(" + ", ".join(taken) + ")"
        steps.append(f"""free_{kind} as (select * replace (list_filter({kind}, lambda m: len(list_filter(
          {seen}, lambda s: s.a < m.b and m.a < s.b)) = 0) as {kind}) from {last})""")
        last = f"free_{kind}"
        taken.append(kind)
    counts = ", ".join(f"cast(len({k}) as bigint) as n_{k}" for k in BASE)
    return ("with " + ",\n".join(steps) + f"\nselect doc_id, {counts}, sha256({_written(BASE)}) as base_sha256, "
            f"{_written(PATTERNS)} as spans from {last}")
