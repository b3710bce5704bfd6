"""Near matches of names in SQL: the Ratcliff-Obershelp ratio of every pair as a recursion.

A pair starts as one segment of each name. The longest block that stands in both segments (the
earliest in the first, then in the second name) is counted, and what lies left and right of it
are two new segments, until nothing is common.
"""

from __future__ import annotations

import oracle_texts as fv

CUTOFF = 0.75


def ratios(pairs: str, out: str) -> str:
    """Tables of (a, b, ratio) for a table of distinct pairs (a, b), both not empty."""
    return f"""
{out}_hit as (
  select a, b, i, j, i - j as d
  from {pairs}, lateral (select unnest(range(1, length(a) + 1)) as i) x,
    lateral (select unnest(range(1, length(b) + 1)) as j) y
  where substr(a, i, 1) = substr(b, j, 1)),
{out}_run as (
  select a, b, i, j, max(i) over (partition by a, b, d, block) - i + 1 as k
  from (select *, i - row_number() over (partition by a, b, d order by i) as block from {out}_hit)),
{out}_seg as (
  select a, b, 1::bigint as a0, length(a) + 1 as a1, 1::bigint as b0, length(b) + 1 as b1, 0::bigint as m
  from {pairs}
  union all
  select a, b, unnest([a0, i + k]), unnest([i, a1]), unnest([b0, j + k]), unnest([j, b1]),
    unnest([k, 0])
  from (
    select a, b, a0, a1, b0, b1, best // 100000000 as k, 9999 - best // 10000 % 10000 as i,
      9999 - best % 10000 as j
    from (
      select s.a, s.b, a0, a1, b0, b1, max(
        least(r.k, a1 - r.i, b1 - r.j) * 100000000 + (9999 - r.i) * 10000 + 9999 - r.j) as best
      from {out}_seg s join {out}_run r
        on r.a = s.a and r.b = s.b and r.i >= a0 and r.i < a1 and r.j >= b0 and r.j < b1
      group by s.a, s.b, a0, a1, b0, b1))),
{out} as (
  select a, b, 2.0 * sum(m)::double / (length(a) + length(b)) as ratio from {out}_seg group by a, b)"""


def near(source: str, norm) -> str:
    """Near matches of a ledger that has roster and matched beside it; needs WITH RECURSIVE."""
    name = norm("counterparty")
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return f"""
able as (
  select distinct staff.normalized_name as a, n.name as b
  from (select distinct {name} as name from {source}) n, roster staff
  where n.name <> '' and staff.normalized_name <> ''
    and n.name not in (select normalized_name from roster)
    and 2.0 * least(length(n.name), length(staff.normalized_name))
      / (length(n.name) + length(staff.normalized_name)) >= {CUTOFF}),
{ratios('able', 'score')},
best as (
  select a, b from score where ratio >= {CUTOFF}
  qualify row_number() over (partition by b order by ratio desc, a desc) = 1),
turned as (select b as a, a as b from best),
{ratios('turned', 'again')},
near as (
  select l.*, staff_name as closest_staff_match, round_even(ratio, 3) as similarity_score,
    {quoted(fv.FUZZY_REASON_HEAD)} || staff_name || {quoted(fv.FUZZY_REASON_MIDDLE)}
      || cast(round_even(ratio * 100, 0) as integer) || '%' || {quoted(fv.FUZZY_REASON_TAIL)}
      as flag_reason
  from {source} l join again on again.a = {name} join roster on again.b = roster.normalized_name
  where l.transaction_id not in (select transaction_id from matched))"""
