"""The registered queries once more, as SQL over the driver's tables."""

from __future__ import annotations

import oracle_texts as fv
from oracle_names import near

# --- Ledgers, as in driver_views.py -------------------------------------------

EV = """ev as (
  select 'EV-' || event_id as transaction_id, ts as date, value as amount,
         event_type as account, props as description, 'User ' || user_id as "user",
         'USER  ' || (k * k * 7) as counterparty
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events))"""

GLE = """gle as (
  select cast(o_orderkey as varchar) as transaction_id, o_orderdate as date,
         o_totalprice as amount, o_orderpriority as account, o_orderstatus as description,
         printf('Customer#%09d', o_orderkey % 50) as "user", c_name as counterparty
  from orders left join customer on o_custkey = c_custkey)"""

PO = """po as (
  select cast(o_orderkey as varchar) as transaction_id, o_orderdate as date,
         o_totalprice as amount, o_orderpriority as account, o_orderstatus as description,
         printf('Customer#%09d', o_orderkey % 50) as "user"
  from orders)"""

LL = """ll as (
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
           as transaction_id,
         l_shipdate as date, l_quantity as amount, l_returnflag as account,
         l_linestatus as description, 'Supplier ' || l_suppkey as counterparty
  from lineitem)"""

# Ids that repeat, missing accounts and counterparties, years of dates; in place of the events
EVR = """ev as (
  select l_orderkey || '-' || l_linenumber as transaction_id, l_shipdate as date,
         l_quantity as amount, case when l_linenumber <> 7 then l_returnflag end as account,
         l_linestatus as description, 'Supplier ' || (l_suppkey % 40) as "user",
         case when l_linenumber <> 6 then 'SUPPLIER  ' || (l_partkey % 97) end as counterparty
  from lineitem)"""

PAGES = """pages_ledger as (
  select cast(page_id as varchar) as transaction_id, cast(length(html) as double) as amount,
    regexp_extract(url, '//[^/]+/([a-z]+)/', 1) as account, url as description,
    regexp_replace(host, '^(www|m|blog)\\.', '') as "user", host as counterparty
  from (select *, regexp_extract(url, '//([^/]+)/', 1) as host from pages))"""

MESSY = """messy as (
  select 'T' || (o_orderkey // 2) as transaction_id,
    case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then 'not-a-date'
         when o_orderpriority = '5-LOW' then strftime(o_orderdate, '%d/%m/%Y %H:%M')
         when o_orderpriority = '4-NOT SPECIFIED' then strftime(o_orderdate, '%Y-%m-%d')
         else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as date,
    case when o_orderpriority = '1-URGENT' then 'TZS ' || cents || '/='
         when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then 'garbage'
         when o_orderpriority = '3-MEDIUM' then '  ' || cents
         when o_orderpriority = '5-LOW' then '$' || cents[1] || ',' || substr(cents, 2)
         else cents end as amount,
    o_orderpriority as account,
    case when o_orderstatus = 'O' then 'N/A' else o_orderstatus end as description,
    cast(o_custkey as varchar) as counterparty,
    case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then null
         else o_orderdate end as good_date,
    case when o_orderpriority = '2-HIGH' and o_orderstatus = 'P' then null
         else o_totalprice end as good_amount
  from (select *, printf('%.2f', o_totalprice) as cents from orders))"""

GL = f"""gl as (
  select 'D' || o_orderkey as transaction_id, o_orderdate as date, o_totalprice as amount,
         '{fv.DISBURSEMENT_ACCOUNT}' as account, c_name as counterparty,
         'LN' || o_orderkey as loan_id
  from orders left join customer on o_custkey = c_custkey
  union all
  select 'R-' || l_orderkey || '-' || l_linenumber, l_shipdate,
         l_extendedprice * (1 - l_discount),
         case when l_returnflag = 'R' then '{fv.REPAYMENT_ACCOUNT}' else 'Loan Fee' end,
         null, 'LN' || l_orderkey
  from lineitem),
balances as (
  select loan_id, total_disbursed, total_repaid,
         total_disbursed - total_repaid as gl_outstanding_balance, borrower
  from (
    select loan_id,
      coalesce(cast(sum(cast(amount as decimal(20,4)))
        filter (account = '{fv.DISBURSEMENT_ACCOUNT}') as double), 0) as total_disbursed,
      coalesce(cast(sum(cast(amount as decimal(20,4)))
        filter (account = '{fv.REPAYMENT_ACCOUNT}') as double), 0) as total_repaid,
      count(*) filter (account in ('{fv.DISBURSEMENT_ACCOUNT}', '{fv.REPAYMENT_ACCOUNT}')) as n,
      arg_min(counterparty, (date, transaction_id)) filter (counterparty is not null) as borrower
    from gl where loan_id is not null group by loan_id)
  where n > 0)"""

RECONCILED = GL + f""",
schedule as (
  select case o_orderpriority when '1-URGENT' then 'XL' else 'LN' end || o_orderkey as loan_id,
         'Borrower ' || o_custkey as borrower,
         o_orderpriority as product,
         round_even((o_totalprice - coalesce(repaid, 0)) *
           case o_orderpriority when '2-HIGH' then 0.99::double when '3-MEDIUM' then 0.9::double
             when '4-NOT SPECIFIED' then 0.5::double else 1.0::double end, 2)
           as schedule_outstanding_balance
  from orders left join (
    select l_orderkey, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(20,4)))
      as double) as repaid
    from lineitem where l_returnflag = 'R' group by l_orderkey) on o_orderkey = l_orderkey
  union all
  select 'CU' || c_custkey, c_name, c_mktsegment, c_acctbal from customer),
joined as (
  select coalesce(b.loan_id, c.loan_id) as loan_id, b.gl_outstanding_balance, c.product,
         c.schedule_outstanding_balance, coalesce(c.borrower, b.borrower) as borrower,
         b.gl_outstanding_balance - c.schedule_outstanding_balance as variance
  from balances b full outer join schedule c on b.loan_id = c.loan_id),
reconciled as (
  select *, case
    when gl_outstanding_balance is not null and schedule_outstanding_balance is null then
      case when abs(gl_outstanding_balance) <= 5000 then '{fv.CLOSED_LOAN}'
           else '{fv.UNSUPPORTED_GL}' end
    when gl_outstanding_balance is null and schedule_outstanding_balance is not null
      then '{fv.GHOST_LOAN}'
    when abs(variance) / greatest(abs(gl_outstanding_balance),
      abs(schedule_outstanding_balance), 1) <= 0.02 then '{fv.CLEAN_TIE_OUT}'
    when abs(variance) / greatest(abs(gl_outstanding_balance),
      abs(schedule_outstanding_balance), 1) <= 0.20 then '{fv.TIMING_DIFFERENCE}'
    else '{fv.MATERIAL_VARIANCE}' end as category
  from joined)"""

NOT_FINDING = f"('{fv.CLEAN_TIE_OUT}', '{fv.CLOSED_LOAN}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- First digits -------------------------------------------------------------

def digits(source: str) -> str:
    return f"""leads as (
  select *, cast(nullif(regexp_extract(cast(abs(amount) as varchar), '[1-9]'), '') as integer)
    as leading_digit from {source}),
digits as (
  select d as digit, count(leading_digit) as actual_count,
         (select count(leading_digit) from leads) as n,
         log10(1 + 1.0 / d) as expected_proportion
  from (select cast(unnest(range(1, 10)) as integer) as d)
  left join leads on leading_digit = d group by d),
shares as (
  select digit, actual_count, n, actual_count / n as actual_proportion, expected_proportion
  from digits)"""


# --- Event ledger screens -------------------------------------------------------

EV_TIERS = [
    (100, "Extremely round (multiple of 100)", 20),
    (50, "Very round (multiple of 50)", 15),
    (10, "Highly round (multiple of 10)", 10),
    (5, "Moderately round (multiple of 5)", 5),
]
LINE_TIERS = [
    (50, "Extremely round (multiple of 50)", 20),
    (25, "Very round (multiple of 25)", 15),
    (20, "Highly round (multiple of 20)", 10),
    (10, "Moderately round (multiple of 10)", 5),
]


def tier_case(tiers) -> str:
    whens = " ".join(
        f"when abs(amount) >= {m} and abs(amount) % {m} = 0 then '{label}'"
        for m, label, _ in tiers)
    return f"case {whens} end"


ROUND_REASON = (f"'{fv.ROUND_REASON_HEAD}' || roundness_tier || "
                f"{quoted(fv.ROUND_REASON_TAIL)}")

SPREAD = """medians as (
  select account, count(*) as account_rows, quantile_cont(amount, 0.5) as median
  from {src} where account is not null group by account),
spread as (
  select m.account, any_value(account_rows) as account_rows, any_value(median) as median,
         quantile_cont(abs(amount - median), 0.5) as mad
  from {src} e join medians m on e.account = m.account group by m.account)"""


def outlier_reason(method: str) -> str:
    name = fv.OUTLIER_METHOD_NAMES[method]
    return (quoted(fv.OUTLIER_REASON_HEAD % name) + f" || account || "
            + quoted(fv.OUTLIER_REASON_MIDDLE) + " || direction || "
            + quoted(fv.OUTLIER_REASON_TAIL))


def modified_z(source: str) -> str:
    return SPREAD.format(src=source) + f""",
mz as (
  select e.*, 0.6745 * (amount - median) / (case when mad = 0 then 1e-9 else mad end) as z,
         median, account_rows, case when amount > median then 'high' else 'low' end as direction
  from {source} e join spread s on e.account = s.account),
outliers as (
  select *, {outlier_reason('modified_zscore')} as flag_reason
  from mz where account_rows >= 4 and abs(z) > 3.5)"""


TIMING = f"""marked as (
  select *, isodow(date) >= 6 as is_weekend, hour(date) < 8 or hour(date) >= 18 as is_after_hours
  from ev),
timing as (
  select *, '{fv.TIMING_REASON_HEAD}' || case
    when is_weekend and is_after_hours
      then '{fv.WEEKEND_REASON} and {fv.AFTER_HOURS_REASON % (8, 18)}'
    when is_weekend then '{fv.WEEKEND_REASON}'
    else '{fv.AFTER_HOURS_REASON % (8, 18)}' end as flag_reason
  from marked where is_weekend or is_after_hours),
users as (
  select *, concentration_ratio >= 1.1 and flagged_transactions >= 3 as flagged
  from (
    select *, round_even(pct_of_flagged / pct_of_total, 2) as concentration_ratio
    from (
      select "user", count(*) as total_transactions,
        count(*) / (select count(*) from ev) as pct_of_total,
        count(*) filter (is_weekend or is_after_hours) as flagged_transactions,
        coalesce(count(*) filter (is_weekend or is_after_hours)
          / nullif((select count(*) from timing), 0), 0) as pct_of_flagged
      from marked where "user" is not null group by "user"))),
high_risk as (
  select * from timing where "user" in (select "user" from users where flagged))"""


def norm(column: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({column}), '\\s+', ' ', 'g')), '')"


def related(source: str) -> str:
    self_dealing, borrower = fv.SELF_DEALING, fv.STAFF_AS_BORROWER
    return f"""roster as (
  select {norm('"user"')} as normalized_name, max("user") as staff_name
  from {source} where "user" is not null group by 1),
matched as (
  select *, case when {norm('counterparty')} = {norm('"user"')} then '{self_dealing}'
    else '{borrower}' end as related_party_category
  from {source}
  where {norm('counterparty')} <> ''
    and {norm('counterparty')} in (select normalized_name from roster)),
related as (
  select *, case related_party_category
    when '{self_dealing}' then {quoted(fv.RELATED_PARTY_REASONS[self_dealing])}
    else {quoted(fv.RELATED_PARTY_REASONS[borrower])} end as flag_reason
  from matched)"""


def duplicates(source: str) -> str:
    return f"""gaps as (
  select *, date - lag(date) over k as after_previous, lead(date) over k - date as before_next
  from {source} window k as (partition by counterparty, account, amount order by date)),
dups as (
  select * exclude (after_previous, before_next),
    '{fv.DUPLICATE_GROUP_PREFIX}' || dense_rank() over (order by
      coalesce(counterparty, {quoted(fv.MISSING_KEY_TEXT)}) || '|' ||
      coalesce(account, {quoted(fv.MISSING_KEY_TEXT)}) || '|' ||
      cast(amount as varchar)) as duplicate_group_id,
    '{fv.DUPLICATE_PAYMENT_REASON % 3}' as flag_reason
  from gaps where after_previous <= interval 3 days or before_next <= interval 3 days)"""


def tier_points(tiers) -> str:
    return "case roundness_tier " + " ".join(
        f"when '{label}' then {points}" for _, label, points in tiers) + " end"


def tier_order(tiers) -> str:
    return "case roundness_tier " + " ".join(
        f"when '{label}' then {i}" for i, (_, label, _) in enumerate(tiers)) + " end"


def benford_rows(tolerance: float) -> str:
    return """over as (
  select digit from shares where actual_proportion - expected_proportion > {tolerance}),
benford as (
  select *, {reason} as flag_reason from leads where leading_digit in (select digit from over))
""".format(reason=quoted(fv.BENFORD_REASON), tolerance=tolerance)

# Every screen on the event ledger
ALL = "with " + ",\n".join([
    EV, digits("ev"), benford_rows(0.005),
    f"rounds as (select *, {ROUND_REASON} as flag_reason from (select *, {tier_case(EV_TIERS)} "
    "as roundness_tier from ev) where roundness_tier is not null)",
    modified_z("ev"), TIMING, related("ev"), duplicates("ev"),
])

CONTRIBUTIONS = ALL + f""",
contributions as (
  select transaction_id, 0 as o, 'Duplicate Payment' as label, 40 as points from dups
  union all select transaction_id, 1, 'Statistical Outlier', 25 from outliers
  union all select transaction_id, 2, 'Journal Entry Timing (User Concentration)', 30
    from high_risk
  union all select transaction_id, 3, 'Benford''s Law', 10 from benford
  union all select transaction_id, 4 + {tier_order(EV_TIERS)},
    'Round Number (' || roundness_tier || ')', {tier_points(EV_TIERS)} from rounds
  union all select transaction_id,
    case related_party_category when '{fv.SELF_DEALING}' then 20 else 21 end,
    'Related Party (' || related_party_category || ')',
    case related_party_category when '{fv.SELF_DEALING}' then 45 else 20 end from related)"""

SCORED = CONTRIBUTIONS + """,
per_id as (
  select transaction_id, sum(n * points) as base_score,
         string_agg(label || ' (+' || points || ')' || case when n > 1 then ' x' || n else '' end,
           '; ' order by o) as score_breakdown
  from (select transaction_id, o, label, points, count(*) as n from contributions
        where transaction_id is not null group by all)
  group by transaction_id),
factored as (
  select e.*, case when median is null or median = 0 then 1.0
    else least(greatest(amount / median, 0.5), 2.0) end as materiality_factor
  from ev e left join medians m on e.account = m.account),
raw as (
  select f.*, cast(base_score as bigint) as base_score, score_breakdown,
         base_score * materiality_factor as raw_score
  from factored f join per_id p on f.transaction_id = p.transaction_id),
scored as (
  select *, case when risk_score >= 60 then 'Critical' when risk_score >= 35 then 'High'
    when risk_score >= 18 then 'Medium' else 'Low' end as risk_rating
  from (select *, round_even(raw_score / (select max(raw_score) from raw) * 100, 1) as risk_score
        from raw))"""

CONSOLIDATED = ALL + """,
reasons as (
  select transaction_id, method_no, min(flag_reason)
           || case when count(*) > 1 then ' x' || count(*) else '' end as flag_reason
  from (
    select transaction_id, 0 as method_no, '' as variant, flag_reason from benford
    union all select transaction_id, 1, '', flag_reason from dups
    union all select transaction_id, 2, roundness_tier, flag_reason from rounds
    union all select transaction_id, 3, direction, flag_reason from outliers
    union all select transaction_id, 4, flag_reason, flag_reason from high_risk
    union all select transaction_id, 5, related_party_category, flag_reason from related)
  group by transaction_id, method_no, variant),
consolidated as (
  select e.*, flagged_benford, flagged_duplicate, flagged_round_number, flagged_outlier,
         flagged_journal_entry, flagged_related_party, flag_count, flag_reasons
  from ev e join (
    select transaction_id, bool_or(method_no = 0) as flagged_benford,
      bool_or(method_no = 1) as flagged_duplicate, bool_or(method_no = 2) as flagged_round_number,
      bool_or(method_no = 3) as flagged_outlier, bool_or(method_no = 4) as flagged_journal_entry,
      bool_or(method_no = 5) as flagged_related_party,
      cast(count(distinct method_no) as integer) as flag_count,
      string_agg(flag_reason, ' | ' order by method_no, flag_reason) as flag_reasons
    from reasons group by transaction_id) r on e.transaction_id = r.transaction_id)"""

EXPOSURE = """coalesce(round_even(cast(sum(cast(amount as decimal(20,4)))
  filter (risk_rating in ('Critical', 'High')) as double), 2), 0)"""

SUM = "coalesce(round_even(cast(sum(cast({} as decimal(20,4))) as double), 2), 0)"

EV_COLUMNS = 'transaction_id, date, amount, account, description, "user", counterparty'
LL_COLUMNS = "transaction_id, date, amount, account, description, counterparty"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # Ingestion
    q["load_ledger"] = f"""with {MESSY}
select transaction_id, good_date as date, good_amount as amount, account,
       case when description <> 'N/A' then description end as description, counterparty
from messy where good_date is not null and good_amount is not null"""
    q["standardize_columns"] = f"""with {MESSY}
select transaction_id, date, amount, account, description, counterparty from messy"""
    q["coerce_dates"] = f"""with {MESSY}
select transaction_id, date as date_text, good_date as date from messy"""
    q["clean_amounts"] = f"""with {MESSY}
select transaction_id, amount as amount_text, good_amount as amount from messy"""
    q["data_quality_report"] = f"""with {MESSY},
kept as (select * from messy where good_date is not null and good_amount is not null)
select count(*) as total_rows_loaded,
  count(*) - (select count(*) from kept) as rows_dropped_bad_date_or_amount,
  count(*) - count(good_date) as bad_dates_found,
  count(*) - count(good_amount) as bad_amounts_found,
  (select count(*) - count(distinct transaction_id) from kept) as duplicate_transaction_ids,
  (select count(*) from kept) as rows_after_cleaning,
  false as has_user_column, true as has_counterparty_column
from messy"""

    # First digits
    po_digits = f"with {PO}, {digits('po')}"
    q["benford_digits"] = po_digits + """
select digit, actual_count, actual_proportion, expected_proportion,
  round_even(actual_proportion * 100, 2) as actual_pct,
  round_even(expected_proportion * 100, 2) as expected_pct
from shares"""
    q["benford_stats"] = po_digits + f""",
t as (
  select any_value(n) as n,
    sum((actual_count - expected_proportion * n) ** 2 / (expected_proportion * n)) as chi2,
    sum(abs(actual_proportion - expected_proportion)) / 9 as mad
  from shares),
u as (
  select *, exp(-chi2/2) * (1 + chi2/2 + (chi2/2)**2 / 2 + (chi2/2)**3 / 6) as p from t)
select n as sample_size, n >= 300 as sample_size_reliable,
  case when n < 300 then printf({quoted(fv.SAMPLE_SIZE_WARNING)}, n, 300) end
    as sample_size_warning,
  round_even(chi2, 3) as chi2_statistic, round_even(p, 5) as p_value,
  p < 0.05 as is_statistically_significant, round_even(mad, 5) as mad_score,
  case when mad < 0.006 then 'Close conformity' when mad < 0.012 then 'Acceptable conformity'
       when mad < 0.015 then 'Marginally acceptable conformity'
       else '{fv.NONCONFORMITY}' end as conformity_rating
from u"""
    q["benford_overrepresented"] = po_digits + """
select digit, round_even(actual_proportion * 100, 2) as actual_pct,
  round_even(expected_proportion * 100, 2) as expected_pct,
  round_even((actual_proportion - expected_proportion) * 100, 2) as excess_pct
from shares where actual_proportion - expected_proportion > 0.01"""
    q["benford_flagged"] = po_digits + f""", {benford_rows(0.01)}
select transaction_id, date, amount, account, description, "user", leading_digit, flag_reason
from benford"""

    # Duplicates
    q["exact_id_duplicates"] = f"""
select l_orderkey || '-' || l_linenumber as transaction_id, l_shipdate as date,
  l_quantity as amount, {quoted(fv.DUPLICATE_ID_REASON)} as flag_reason
from lineitem
qualify count(*) over (partition by l_orderkey, l_linenumber) > 1"""
    ll_dups = f"with {LL}, {duplicates('ll')}"
    q["duplicate_payments"] = ll_dups + f"""
select {LL_COLUMNS}, duplicate_group_id, flag_reason from dups"""
    q["duplicate_summary"] = ll_dups + f"""
select count(distinct duplicate_group_id) as duplicate_groups_found,
  count(*) as total_flagged_transactions, {SUM.format('amount')} as total_exposure from dups"""

    # Round amounts
    ll_rounds = f"""with {LL}, rounds as (
  select *, {ROUND_REASON} as flag_reason
  from (select *, {tier_case(LINE_TIERS)} as roundness_tier from ll)
  where roundness_tier is not null)"""
    q["round_numbers"] = ll_rounds + f"""
select {LL_COLUMNS}, roundness_tier, flag_reason from rounds"""
    q["round_number_summary"] = ll_rounds + f"""
select coalesce(roundness_tier, '(all tiers)') as roundness_tier, count(*) as total_flagged,
  {SUM.format('amount')} as total_exposure
from rounds group by rollup (roundness_tier)"""

    # Outliers
    ev_mz = f"with {EV}, {modified_z('ev')}"
    q["outliers_modified_zscore"] = ev_mz + f"""
select {EV_COLUMNS}, round_even(z, 2) as modified_z_score,
  round_even(median, 2) as account_median, direction, flag_reason from outliers"""
    q["outlier_summary"] = ev_mz + f"""
select count(*) as total_flagged, count(*) filter (direction = 'high') as high_side,
  count(*) filter (direction = 'low') as low_side, {SUM.format('amount')} as total_value
from outliers"""
    q["outliers_by_account"] = ev_mz + """
select account, count(*) as outliers_flagged from outliers group by account"""
    boxes = """boxes as (
  select account, count(*) as account_rows, quantile_cont(amount, 0.25) as q1,
    quantile_cont(amount, 0.5) as median, quantile_cont(amount, 0.75) as q3
  from ev where account is not null group by account)"""
    q["outliers_iqr"] = f"""with {EV}, {boxes},
fences as (
  select account, q1, q3, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper
  from boxes where account_rows >= 4),
hits as (
  select e.*, q1, q3, lower, upper, case when amount > upper then 'high' else 'low' end
    as direction
  from ev e join fences f on e.account = f.account where amount < lower or amount > upper)
select {EV_COLUMNS}, round_even(q1, 2) as account_q1, round_even(q3, 2) as account_q3,
  round_even(lower, 2) as iqr_lower_bound, round_even(upper, 2) as iqr_upper_bound,
  direction, {outlier_reason('iqr')} as flag_reason from hits"""
    q["outliers_zscore"] = f"""with {EV},
moments as (
  select account, count(*) as n, avg(amount) as mean, stddev_samp(amount) as std
  from ev where account is not null group by account),
hits as (
  select e.*, mean, (amount - mean) / std as z,
    case when amount > mean then 'high' else 'low' end as direction
  from ev e join moments m on e.account = m.account
  where n >= 4 and std <> 0 and abs((amount - mean) / std) > 3)
select {EV_COLUMNS}, round_even(z, 2) as z_score, round_even(mean, 2) as account_mean,
  direction, {outlier_reason('zscore')} as flag_reason from hits"""
    q["account_box_stats"] = f"""with {EV}, {boxes}
select b.account, any_value(account_rows) as account_rows,
  round_even(any_value(q1), 2) as q1, round_even(any_value(median), 2) as median,
  round_even(any_value(q3), 2) as q3,
  round_even(least(min(amount) filter (amount >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 2)
    as whisker_low,
  round_even(greatest(max(amount) filter (amount <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 2)
    as whisker_high
from boxes b join ev e on e.account = b.account group by b.account"""

    # Posting times
    ev_timing = f"with {EV}, {TIMING}"
    q["timing_anomalies"] = ev_timing + f"""
select {EV_COLUMNS}, is_weekend, is_after_hours, flag_reason from timing"""
    q["user_concentration"] = ev_timing + """
select "user", total_transactions, pct_of_total, flagged_transactions, pct_of_flagged,
  concentration_ratio, flagged from users"""
    q["high_risk_timing"] = ev_timing + f"""
select {EV_COLUMNS}, is_weekend, is_after_hours, flag_reason from high_risk"""
    q["timing_summary"] = ev_timing + """
select count(*) filter (is_weekend or is_after_hours) as total_timing_anomalies,
  count(*) filter (is_weekend) as weekend_postings,
  count(*) filter (is_after_hours) as after_hours_postings,
  (select count(*) from users where flagged) as flagged_users
from marked"""
    q["user_share_chart"] = ev_timing + """
select "user", round_even(pct_of_total * 100, 2) as pct_of_volume,
  round_even(pct_of_flagged * 100, 2) as pct_of_anomalies, concentration_ratio
from users where flagged_transactions > 0"""

    # Related parties
    order_related = f"with {GLE}, {related('gle')}"
    q["staff_roster"] = order_related + """
select normalized_name, staff_name from roster"""
    q["related_party"] = order_related + f"""
select {EV_COLUMNS}, related_party_category, flag_reason from related"""
    q["related_party_summary"] = order_related + """
select related_party_category, count(*) as transactions from related group by 1"""

    page_near = f"with recursive {PAGES}, {related('pages_ledger')}, {near('pages_ledger', norm)}"
    q["related_party_fuzzy"] = page_near + """
select transaction_id, amount, account, description, "user", counterparty, closest_staff_match,
  similarity_score, flag_reason from near"""
    order_near = f"with recursive {GLE}, {related('gle')}, {near('gle', norm)}"
    q["related_party_fuzzy_customers"] = order_near + f"""
select {EV_COLUMNS}, closest_staff_match, similarity_score, flag_reason from near"""
    q["related_party_summary_near"] = order_near + f"""
select related_party_category, count(*) as transactions from related group by 1
union all select '{fv.NEAR_MATCH}', count(*) from near"""

    # Score and consolidation
    q["materiality_factor"] = f"""with {GLE}, {SPREAD.format(src='gle')}
select transaction_id, e.account, amount, case when median is null or median = 0 then 1.0
  else least(greatest(amount / median, 0.5), 2.0) end as materiality_factor
from gle e left join medians m on e.account = m.account"""
    q["risk_contributions"] = CONTRIBUTIONS + """
select transaction_id, label, points from contributions"""
    q["risk_scores"] = SCORED + f"""
select {EV_COLUMNS}, base_score, score_breakdown, materiality_factor, raw_score, risk_score,
  risk_rating from scored"""
    q["risk_summary"] = SCORED + f"""
select count(*) as total_flagged, count(*) filter (risk_rating = 'Critical') as critical,
  count(*) filter (risk_rating = 'High') as high,
  count(*) filter (risk_rating = 'Medium') as medium,
  count(*) filter (risk_rating = 'Low') as low, {EXPOSURE} as total_exposure_critical_high
from scored"""
    q["rating_breakdown"] = SCORED + """
select r as risk_rating, count(risk_rating) as transactions
from (select unnest(['Critical', 'High', 'Medium', 'Low']) as r)
left join scored on risk_rating = r group by r"""
    q["monthly_trend"] = SCORED + """
select strftime(date, '%Y-%m') as month,
  count(*) filter (risk_rating = 'Critical') as critical,
  count(*) filter (risk_rating = 'High') as high,
  count(*) filter (risk_rating = 'Medium') as medium,
  count(*) filter (risk_rating = 'Low') as low
from scored group by 1"""
    q["top_risk"] = SCORED + """
select transaction_id, date, amount, account, risk_score, risk_rating, score_breakdown
from scored order by risk_score desc, transaction_id, date, amount, account limit 15"""
    q["flags_by_method"] = ALL + """
select 'Benford''s Law' as method, count(*) as flagged_rows from benford
union all select 'Duplicate Payments', count(*) from dups
union all select 'Round Numbers', count(*) from rounds
union all select 'Statistical Outliers', count(*) from outliers
union all select 'Journal Entry Timing', count(*) from high_risk
union all select 'Related Party', count(*) from related"""
    q["consolidated_findings"] = CONSOLIDATED + "\nselect * from consolidated"
    q["flag_count_breakdown"] = CONSOLIDATED + """
select flag_count, count(*) as transactions from consolidated group by flag_count"""
    q["multi_flag_leads"] = CONSOLIDATED + "\nselect * from consolidated where flag_count >= 2"

    for name in ("risk_scores", "consolidated_findings", "monthly_trend"):
        repeated = name.replace("_findings", "") + "_repeated_ids"
        q[repeated] = q[name].replace(EV, EVR)
    q["duplicate_payments_open_parties"] = f"""with {EVR}, {duplicates('ev')}
select {EV_COLUMNS}, duplicate_group_id, flag_reason from dups"""

    # Loans
    q["gl_loan_balances"] = f"with {GL}\nselect * from balances"
    q["loan_reconciliation"] = f"with {RECONCILED}\nselect * from reconciled"
    q["reconciliation_findings"] = f"""with {RECONCILED}
select * from reconciled where category not in {NOT_FINDING}"""
    count_of = "count(*) filter (category = '{}') as {}"
    names = ["ghost_loans", "unsupported_gl", "material_variances", "timing_differences",
             "clean_tie_outs", "closed_loans"]
    counts = ", ".join(count_of.format(c, n) for c, n in zip(fv.RECONCILIATION_ORDER, names))
    gl_sum = "cast(sum(cast(gl_outstanding_balance as decimal(20,4))) as double)"
    sc_sum = "cast(sum(cast(schedule_outstanding_balance as decimal(20,4))) as double)"
    q["reconciliation_summary"] = f"""with {RECONCILED}
select count(*) as total_loans_reviewed, round_even({gl_sum}, 2) as total_gl_balance,
  round_even({sc_sum}, 2) as total_schedule_balance,
  round_even({gl_sum} - {sc_sum}, 2) as net_variance, {counts}
from reconciled"""
    q["reconciliation_bars"] = f"""with {RECONCILED}
select loan_id, category,
  coalesce(variance, gl_outstanding_balance, -schedule_outstanding_balance) as plot_value
from reconciled where category not in {NOT_FINDING}"""
    q["engagement_kpis"] = SCORED + f""",
{RECONCILED}
select count(*) as transactions_flagged, count(*) filter (risk_rating = 'Critical') as critical,
  count(*) filter (risk_rating = 'High') as high, {EXPOSURE} as exposure_critical_high,
  (select count(*) from ev) as transactions_reviewed,
  (select count(*) from reconciled) as loans_reviewed,
  (select count(*) from reconciled where category not in {NOT_FINDING})
    as reconciliation_exceptions,
  (select count(*) from reconciled where category = '{fv.GHOST_LOAN}') as possible_ghost_loans
from scored"""
    return q
