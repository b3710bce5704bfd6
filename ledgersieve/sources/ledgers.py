"""Reading and standardising ledgers of transactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve import fixed_values as fv

SCHEDULE_SCHEMA = T.StructType([
    T.StructField("loan_id", T.StringType()),
    T.StructField("borrower", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("officer", T.StringType()),
    T.StructField("disbursement_date", T.TimestampNTZType()),
    T.StructField("disbursement_amount", T.DoubleType()),
    T.StructField("schedule_outstanding_balance", T.DoubleType()),
])

# A number as a program prints it, with an exponent if need be.
PLAIN_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"
# Everything but digits, point and minus, and the texts for "no number" that contain digits.
NOT_PART_OF_A_NUMBER = r"^\s*-?1\.#(?:IND|QNAN)\s*$|[^0-9.\-]"
# A date that starts like an ISO date; anything else needs a format of its own.
ISO_DATE = r"^\s*(\d{4}-\d{1,2}-\d{1,2}(?:[T ].*)?)$"


# Written forms of dates that are looked for where no format is given, in this order; a
# time may follow each. The forms of one row of the table differ in nothing but which of
# day and month comes first.
TIME_PART = "[ HH:mm[:ss]]"
DATE_FORMS = (
    ("yyyy/M/d",),
    ("d/M/yyyy", "M/d/yyyy"),
    ("d-M-yyyy", "M-d-yyyy"),
    ("d.M.yyyy", "M.d.yyyy"),
    ("d MMM yyyy",),
    ("d-MMM-yyyy",),
    ("MMM d, yyyy",),
)


class DataValidationError(Exception):
    """The ledger does not meet the minimum a screen needs."""


# --- Scans ----------------------------------------------------------------

def lines_are_rows(spark: SparkSession, path: str) -> bool:
    """Whether delimited text can be cut at any line end: no quoted text goes on in the next line.

    A row that does so has a line with an odd number of quotes. One scan that many tasks share
    counts such lines, and carriage returns that don't end a line or end some lines only.
    """
    line = F.col("value")
    returned, total = F.count_if(F.endswith(line, F.lit("\r"))), F.count("*")
    odd = F.count_if((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1)
    inner = F.count_if(line.rlike("\r."))
    safe = (odd == 0) & (inner == 0) & ((returned == 0) | (returned == total))
    return spark.read.option("lineSep", "\n").text(path).agg(safe.alias("safe")).first()["safe"]


def _read_text(spark: SparkSession, path: str, line_breaks: bool | None) -> DataFrame:
    """Delimited text with a header; a quote inside quotes is written twice."""
    if line_breaks is None:
        line_breaks = not lines_are_rows(spark, path)
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", line_breaks).csv(path))


def read_raw(
    spark: SparkSession, path: str, fmt: str | None = None, line_breaks: bool | None = None
) -> DataFrame:
    """A ledger as it lies on disk: delimited text (all columns text) or Parquet.

    Quoted texts may hold line breaks, which keeps a file from being split. Unless the caller
    says so, one scan finds out whether any does; without any, tasks share each file.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return _read_text(spark, path, line_breaks)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file type: {kind}. Use csv or parquet.")


def read_schedule(
    spark: SparkSession, path: str, line_breaks: bool | None = None
) -> DataFrame:
    """The loan schedule; columns are matched by name, extra columns are dropped."""
    raw = _read_text(spark, path, line_breaks)
    columns = {
        field.name: F.col(field.name).try_cast(field.dataType)
        if field.name in raw.columns
        else F.lit(None).cast(field.dataType)
        for field in SCHEDULE_SCHEMA
    }
    return raw.select(*(column.alias(name) for name, column in columns.items()))


# --- Columns --------------------------------------------------------------

def folded(header: str) -> str:
    """The form in which headers are compared: case, outer blanks and inner blanks aside."""
    return "_".join(header.strip(" ").split(" ")).lower()


def match_columns(
    columns: Sequence[str], aliases: Mapping[str, Sequence[str]], required: bool
) -> dict[str, str]:
    """Standard name -> header in the file.

    Every alias stands for a standard name with a rank, its place in that name's list; of
    the headers that stand for one name, the one of lowest rank is taken. Headers that fold
    to the same form can't be told apart: if one of them is needed, that is an error.
    """
    meaning = {alias: (rank, standard) for standard, names in aliases.items()
               for rank, alias in reversed(list(enumerate(names)))}
    claims: dict[str, dict[int, list[str]]] = {standard: {} for standard in aliases}
    for header in columns:
        if folded(header) in meaning:
            rank, standard = meaning[folded(header)]
            claims[standard].setdefault(rank, []).append(header)
    matched = {}
    for standard, by_rank in claims.items():
        if by_rank:
            headers = by_rank[min(by_rank)]
            if len(headers) > 1:
                raise DataValidationError(f"Headers {headers} are the same name for {standard!r}.")
            matched[standard] = headers[0]
    absent = [standard for standard in aliases if standard not in matched]
    if required and absent:
        raise DataValidationError(
            f"No header stands for {absent}; the file has {list(columns)}.")
    return matched


def standardise_columns(raw: DataFrame) -> DataFrame:
    """Rename recognised columns to their standard names and drop the others."""
    matched = match_columns(raw.columns, fv.REQUIRED_ALIASES, required=True)
    matched |= match_columns(raw.columns, fv.OPTIONAL_ALIASES, required=False)
    return raw.select(*(F.col(f"`{found}`").alias(name) for name, found in matched.items()))


# --- Values ---------------------------------------------------------------

def missing_to_null(column: Column) -> Column:
    return F.when(~F.trim(column).isin(fv.MISSING_TOKENS), column)


def parse_date(column: Column, formats: Sequence[str] = ()) -> Column:
    """ISO dates first, then the caller's formats in order; null if none fits."""
    iso = F.regexp_extract(column, ISO_DATE, 1).try_cast("timestamp_ntz")
    others = [F.try_to_timestamp(F.trim(column), F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(iso, *others)


def detect_date_formats(raw: DataFrame) -> list[str]:
    """The written form that fits most of the dates that are not ISO dates, counted over all rows.

    One pass over the date column. No format if none fits. It is an error if day first and
    month first fit equally many: nothing in the data tells them apart.
    """
    named = standardise_columns(raw)
    if dict(named.dtypes)["date"] != "string":
        return []
    column = F.col("date")
    other = parse_date(column).isNull()
    forms = [form for group in DATE_FORMS for form in group]
    fitting = named.agg(*(
        F.count_if(other & F.try_to_timestamp(F.trim(column), F.lit(form + TIME_PART)).isNotNull())
        .alias(f"form{i}") for i, form in enumerate(forms))).first()
    counts = dict(zip(forms, fitting, strict=True))
    best = max(forms, key=lambda form: counts[form])
    if not counts[best]:
        return []
    for group in DATE_FORMS:
        if best in group and len({counts[form] for form in group}) < len(group):
            raise DataValidationError(
                f"The dates fit {' and '.join(group)} equally well; name the format.")
    return [best + TIME_PART]


def parse_number(column: Column) -> Column:
    """A plain number as it is; otherwise the digits, point and minus that remain."""
    plain = F.regexp_extract(column, PLAIN_NUMBER, 1).try_cast("double")
    cleaned = F.regexp_replace(column, NOT_PART_OF_A_NUMBER, "").try_cast("double")
    return F.coalesce(plain, cleaned)


def parse_amount(column: Column) -> Column:
    return finite(parse_number(column))


def finite(number: Column) -> Column:
    """Null for what is not a number and for what no double can hold."""
    return F.when(F.abs(number) < float("inf"), number)


def coerce_types(ledger: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """Dates and amounts as such, missing-value texts as null; no row is dropped.

    Texts of dates and amounts are parsed once a row. What is parsed stands in a list of one
    entry that is unfolded: the optimizer would otherwise write the parser once into the
    filter that drops unusable rows and once more into what they keep.
    """
    types = dict(ledger.dtypes)
    parsers = {"date": lambda c: parse_date(c, date_formats), "amount": parse_number}
    texts = [name for name in parsers if types.get(name) == "string"]
    if texts:
        parsed = F.inline(F.array(F.struct(*(
            parsers[name](F.col(name)).alias(name) for name in texts))))
        ledger = ledger.select(
            *(name for name in ledger.columns if name not in texts), parsed
        ).select(*ledger.columns)

    def typed(name: str) -> Column:
        column = F.col(name)
        if name == "date":
            parsed_or_time = name in texts or types[name].startswith("timestamp")
            return column if parsed_or_time else column.cast("timestamp_ntz")
        if name == "amount":
            return finite(column if name in texts else column.cast("double"))
        return missing_to_null(column) if types[name] == "string" else column

    return ledger.select(*(typed(name).alias(name) for name in ledger.columns))


def drop_unusable(ledger: DataFrame) -> DataFrame:
    return ledger.dropna(subset=["date", "amount"])


def standardise(raw: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """From a raw table to a ledger ready for screening. Lazy; see ``validate``."""
    return drop_unusable(coerce_types(standardise_columns(raw), date_formats))


def load_ledger(
    spark: SparkSession, path: str, date_formats: Sequence[str] | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """The ledger in a file; without formats, the form of its dates is looked for."""
    raw = read_raw(spark, path, fmt)
    return standardise(raw, detect_date_formats(raw) if date_formats is None else date_formats)


def validate(raw: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    """Like ``standardise``, but looks at the data and raises if nothing is left."""
    if raw.isEmpty():
        raise DataValidationError("The ledger contains no rows.")
    if date_formats is None:
        date_formats = detect_date_formats(raw)
    ledger = standardise(raw, date_formats)
    if ledger.isEmpty():
        raise DataValidationError("All rows were dropped. Check date and amount formats.")
    return ledger


# --- Data quality ---------------------------------------------------------

def data_quality_report(raw: DataFrame, date_formats: Sequence[str] = ()) -> DataFrame:
    """One row of counts about what standardising keeps and drops."""
    typed = coerce_types(standardise_columns(raw), date_formats)
    no_date, no_amount = F.col("date").isNull(), F.col("amount").isNull()
    # Per id first: partial counts combine before the shuffle, so a frequent id is one row.
    per_id = typed.groupBy("transaction_id").agg(
        F.count("*").alias("loaded"),
        F.count_if(no_date).alias("bad_dates"),
        F.count_if(no_amount).alias("bad_amounts"),
        F.count_if(no_date | no_amount).alias("dropped"),
    )
    usable = F.col("loaded") - F.col("dropped")

    def added(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return per_id.agg(
        added(F.col("loaded")).alias("total_rows_loaded"),
        added(F.col("dropped")).alias("rows_dropped_bad_date_or_amount"),
        added(F.col("bad_dates")).alias("bad_dates_found"),
        added(F.col("bad_amounts")).alias("bad_amounts_found"),
        added(F.greatest(usable - 1, F.lit(0))).alias("duplicate_transaction_ids"),
        added(usable).alias("rows_after_cleaning"),
        F.lit("user" in typed.columns).alias("has_user_column"),
        F.lit("counterparty" in typed.columns).alias("has_counterparty_column"),
    )
