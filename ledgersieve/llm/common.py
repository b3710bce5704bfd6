"""What several of these operators share: rows by Arrow batch, words, text keys, files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgersieve.shipping import ship_package

#: Vocabularies larger than this aren't sent to executors.
MAX_VOCABULARY_BYTES = 64 * 1024 * 1024
#: Texts of one call of a batch function together have about this many characters.
CHARS_PER_CALL = 4_000_000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def renamed(docs: DataFrame, needed: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with every column but the needed ones named by its place.

    Operators that hand all columns on work under these names, so that no column of the
    caller's can clash with theirs, and give the old names back with ``toDF``.
    """
    places = {docs.columns.index(name): name for name in needed if name in docs.columns}
    return docs.toDF(*[places.get(i, f"extra{i}") for i in range(len(docs.columns))])


def pick(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns only, also where other columns differ from them only in case."""
    return renamed(docs, needed).select(*needed)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space and the characters from tab to carriage return."""
    return text.encode("utf-8", "replace").split() if text else []


def text_key(text: Column) -> Column:
    """A key of the whole text, by which rows that hold the same text meet."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slices(texts: Sequence[str | None], chars: int = CHARS_PER_CALL) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each, so that memory is bounded."""
    start = held = 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    made: str,
    start: Callable[[], Callable[[list[str | None]], list[Sequence]]],
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` and those that a function of the texts makes, batch by batch.

    ``start`` is called once a task and returns a function from a list of texts to one
    sequence for each field of ``made``, given as DDL. Callers keep
    only columns whose names differ from the made ones.
    """
    ship_package(df.sparkSession)
    fields = T.StructType.fromDDL(made).fields
    schema = T.StructType([*[df.schema[name] for name in keep], *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in slices(texts):
                columns = [pa.array(v, k) for v, k in zip(work(texts[a:b]), kinds, strict=True)]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=names)

    source = df.select(*[F.col(f"`{name}`") for name in keep], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, schema)


def filter_texts(
    df: DataFrame, start: Callable[[], Callable[[list[str | None]], Sequence[bool]]],
    text: str = "text",
) -> DataFrame:
    """All columns of the rows for whose text a function says yes."""
    ship_package(df.sparkSession)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            said = [bool(x) for a, b in slices(texts) for x in work(texts[a:b])]
            yield batch.filter(pa.array(said, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer's file, read by the driver and sent to executors: its size is checked."""
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)
