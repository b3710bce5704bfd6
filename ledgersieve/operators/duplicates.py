"""Repeated ids and repeated payments."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.operators.numbering import consecutive_numbers
from ledgersieve.sources.kept import kept

KEY = ["key_party", "key_account", "key_amount"]


def exact_id_duplicates(ledger: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """All rows whose id occurs more than once; missing ids count as equal."""
    # Counted with partial sums, then a semi-join that the planner may split on a
    # frequent id; a window over the id would put all its rows into one task.
    repeated = (
        ledger.groupBy(F.col(id_col).alias("repeated_id"))
        .agg(F.count("*").alias("occurrences"))
        .filter(F.col("occurrences") > 1)
        .select("repeated_id")
    )
    return ledger.join(
        repeated, F.col(id_col).eqNullSafe(F.col("repeated_id")), "left_semi"
    ).withColumn("flag_reason", F.lit(fv.DUPLICATE_ID_REASON))


def _key_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(fv.MISSING_KEY_TEXT))


def _window_micros(cfg: ScreenConfig) -> int:
    return int(cfg.duplicate_window_days * s.MICROS_PER_DAY)


def _keyed(
    ledger: DataFrame, cfg: ScreenConfig, amount: str, date: str, counterparty: str, account: str
) -> DataFrame:
    """The ledger with its duplicate key and the time slot of each row.

    A slot is as wide as the window, so two rows of one key in one slot are always
    close enough, and a row alone in its slot can only be close to the last row of
    the slot before or the first row of the slot after.
    """
    rows = ledger
    if cfg.null_counterparty == "ignore":
        rows = rows.filter(F.col(counterparty).isNotNull())
    clock, reach = s.clock_micros(F.col(date)), max(_window_micros(cfg), 1)
    return rows.withColumns({
        "key_party": _key_text(counterparty),
        "key_account": _key_text(account),
        "key_amount": F.col(amount),
        "clock": clock,
        "slot": clock - F.pmod(clock, F.lit(reach)),
    }).withColumns(_block(reach))


def _block(reach: int) -> dict[str, Column]:
    """Slots in blocks of 64: the number of a slot's block, and the bit that stands for it."""
    number = f"(slot div {reach}L)"
    return {"slot_block": F.expr(f"shiftright({number}, 6)"),
            "slot_bit": F.expr(f"shiftleft(1L, cast({number} & 63 as int))")}


#: Slots of one key that a window looks at together, besides one neighbour on either side.
STRETCH_SLOTS = 1024


def _stretched(slots: DataFrame, reach: int) -> DataFrame:
    """Slots with the stretch of their key that they lie in; those at a border are guests
    of the stretch beside it too."""
    number = F.expr(f"(slot - pmod(slot, {reach}L)) div {reach}L")
    at = F.pmod(number, F.lit(STRETCH_SLOTS))
    own, first, last = F.floor(number / STRETCH_SLOTS), at == 0, at == STRETCH_SLOTS - 1
    # as cases, since a function of each entry of an array is not compiled
    seen_by = (
        F.when(first & last, F.array(own, own - 1, own + 1)).when(first, F.array(own, own - 1))
        .when(last, F.array(own, own + 1)).otherwise(F.array(own)))
    return slots.select("*", own.alias("own"), F.explode(seen_by).alias("stretch"))


def _close_slots(keyed: DataFrame, cfg: ScreenConfig) -> DataFrame:
    """Key and slot of all rows that have a neighbour within the window.

    Rows are counted per key and slot with partial sums first. The window below then
    sees one row per slot and STRETCH_SLOTS slots at a time, however many rows or
    slots a key has. Without a window in time, equal times are all there is to count.
    """
    reach = _window_micros(cfg)
    slots = keyed.groupBy(*KEY, "slot").agg(
        F.count("*").alias("slot_rows"), F.min("clock").alias("first"), F.max("clock").alias("last"))
    if reach < 1:
        return slots.filter(F.col("slot_rows") > 1).select(*KEY, "slot")
    in_stretch = Window.partitionBy(*KEY, "stretch").orderBy("slot")
    after_previous = F.col("first") - F.lag("last").over(in_stretch)
    before_next = F.lead("first").over(in_stretch) - F.col("last")
    return (
        _stretched(slots, reach).withColumn("after_previous", after_previous)
        .withColumn("before_next", before_next)
        .filter(
            (F.col("slot_rows") > 1)
            | (F.col("after_previous") <= reach)
            | (F.col("before_next") <= reach)
        )
        .filter(F.col("own") == F.col("stretch"))
        .select(*KEY, "slot")
    )


def _no_rows(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.lit(False))


def close_slots(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    date: str = "date",
    counterparty: str = "counterparty",
    account: str = "account",
) -> DataFrame | None:
    """Keys and blocks of time slots that hold duplicates, as a table of known size.

    ``slot_bits`` has a bit for each slot of a block that does. Where duplicates are rare, or
    where a key has many of them, the table is small and the ledger need not be shuffled to
    find their rows. None without a counterparty column: account and amount alone repeat
    too often for standard products.
    """
    if counterparty not in ledger.columns:
        return None
    close = _close_slots(_keyed(ledger, cfg, amount, date, counterparty, account), cfg)
    return kept(
        close.withColumns(_block(max(_window_micros(cfg), 1))).groupBy(*KEY, "slot_block")
        .agg(F.bit_or("slot_bit").alias("slot_bits")), "close-slots")


def _is_close() -> Column:
    return F.col("slot_bits").bitwiseAND(F.col("slot_bit")) != 0


def duplicate_payment_rows(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    date: str = "date",
    counterparty: str = "counterparty",
    account: str = "account",
    slots: DataFrame | None = None,
) -> DataFrame:
    """Rows with the same counterparty, account and amount within the window of another.

    Like ``duplicate_payments`` but without group ids, which scoring does not need.
    """
    if slots is None:
        slots = close_slots(ledger, cfg, amount, date, counterparty, account)
    if slots is None:
        return _no_rows(ledger)
    keyed = _keyed(ledger, cfg, amount, date, counterparty, account)
    return keyed.join(slots, [*KEY, "slot_block"]).where(_is_close()).select(*ledger.columns)


def with_duplicate_mark(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    date: str = "date",
    counterparty: str = "counterparty",
    account: str = "account",
    slots: DataFrame | None = None,
) -> DataFrame:
    """Every row with ``duplicate_hit``: whether it is one of ``duplicate_payment_rows``.

    A key and block is listed once, so the join neither adds nor drops rows.
    """
    if slots is None:
        slots = close_slots(ledger, cfg, amount, date, counterparty, account)
    if slots is None:
        return ledger.withColumn("duplicate_hit", F.lit(False))
    # Rows without a counterparty are kept even where they form no key
    keyed = _keyed(ledger, replace(cfg, null_counterparty="group"), amount, date, counterparty, account)
    if cfg.null_counterparty == "ignore":
        keyed = keyed.withColumn(
            "key_party", F.when(F.col(counterparty).isNotNull(), F.col("key_party")))
    return keyed.join(slots, [*KEY, "slot_block"], "left").select(
        *ledger.columns, F.coalesce(_is_close(), F.lit(False)).alias("duplicate_hit"))


def duplicate_reason(cfg: ScreenConfig) -> Column:
    return F.lit(fv.DUPLICATE_PAYMENT_REASON % f"{cfg.duplicate_window_days:g}")


def duplicate_payments(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    date: str = "date",
    counterparty: str = "counterparty",
    account: str = "account",
    slots: DataFrame | None = None,
) -> DataFrame:
    """Potential duplicate payments with a group id per key text, in the order of the texts.

    Keys that read alike (a name may hold the separator) share a group.
    """
    if slots is None:
        slots = close_slots(ledger, cfg, amount, date, counterparty, account)
    if slots is None:
        return _no_rows(ledger).withColumns({
            "duplicate_group_id": F.lit(None).cast("string"),
            "flag_reason": F.lit(None).cast("string"),
        })
    keyed = _keyed(ledger, cfg, amount, date, counterparty, account)
    key_text = F.concat_ws("|", "key_party", "key_account", s.float_text(F.col("key_amount")))
    keys = kept(slots.select(*KEY).distinct().withColumn("key_text", key_text), "keys")
    numbers = consecutive_numbers(keys.select("key_text").distinct(), "key_text", "group_no")
    groups = keys.join(numbers, "key_text").select(
        *KEY,
        F.concat(F.lit(fv.DUPLICATE_GROUP_PREFIX), F.col("group_no").cast("string"))
        .alias("duplicate_group_id"),
    )
    numbered = kept(slots.join(groups, KEY), "numbered-slots")
    return keyed.join(numbered, [*KEY, "slot_block"]).where(_is_close()).select(
        *ledger.columns, "duplicate_group_id", duplicate_reason(cfg).alias("flag_reason"))


def summarize_duplicates(flagged: DataFrame, amount: str = "amount") -> DataFrame:
    per_group = flagged.groupBy("duplicate_group_id").agg(
        F.count("*").alias("rows"), s.total(F.col(amount)).alias("value"))
    return per_group.agg(
        F.count("duplicate_group_id").alias("duplicate_groups_found"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_flagged_transactions"),
        s.rint_to(s.total(F.col("value")), 2).alias("total_exposure"),
    )
