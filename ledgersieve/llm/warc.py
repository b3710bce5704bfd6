"""Pages written to web archives, read back, and ordered as capture histories.

Writing. Each page is one WARC 1.1 record: an HTTP response whose body is the page in UTF-8, or,
where pages have equal bodies of at least ``min_bytes`` bytes, a revisit that refers to the one of
them with the largest id and holds the HTTP head only. Spark's text writer writes the archives,
so they may lie in any store and a lost task leaves nothing behind: a record is a line whose end
is the two line breaks that end a record. Bodies that hold the first line of a record are sent in
chunks (an HTTP transfer coding) cut inside it, so in an archive that line only begins records.

Reading. Spark's text reader cuts archives at that line, which also lets tasks share a large
archive. A record's head, its length, chunks and digest are read from bytes; ``intact`` says
whether length and digest are what the head says.

Index. What a task has read, sorted by URL key, time and id, is a run, written as it is. Runs are
dealt out by ranges of (URL key, time, id), so that a host or page captured again and again is cut
like any other, and each range merges its pieces of all runs with a loser tree: one comparison for
each level of the tree and capture. Partitions in order give all captures in order.

Odd rows: a null page is empty, a null address is left out of the record. Rows of one id are one
record each; if the largest id among equal bodies repeats, each row of it is a response. A null
id is never referred to: it is a revisit of any equal page that has an id, else a response. Where
no time of capture is given, it follows from the id (seconds). Blanks and control characters in
addresses are percent-encoded. Other columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersieve.llm.common import pick
from ledgersieve.shipping import ship_package
from ledgersieve.sources.kept import kept, shared_folder

FIRST_LINE = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_HEAD = "urn:page:"
#: Captures that one task merges, about.
RANGE_CAPTURES = 16_384
CAPTURE = ("url_key string, captured string, page_id long, url string, record_type string, "
           "refers_to long, payload_bytes long, payload_digest string, intact boolean")
_YEAR_2100 = 4_102_444_800


def _base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits are four digits of 32."""
    digits = "".join("0123456789ABCDEFGHIJKLMNOPQRSTUV")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), digits, letters)


def _encoded(url: Column) -> Column:
    """Blanks and control characters of an address as per cent and two digits."""
    odd = F.transform(F.split(url, ""), lambda c: F.when(
        c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0")))
        .otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.concat_ws("", odd)).otherwise(url)


def records(pages: DataFrame, min_bytes: int = 0, captured: str | None = None) -> DataFrame:
    """One record for each page, as text without the line breaks that end it.

    Which pages have equal bodies is found on digests alone; bodies are joined with what was
    found, of which there is one row for each body that occurs more than once.
    """
    named = pick(pages, "page_id", "url", "html", *([captured] if captured else []))
    time = F.col(captured) if captured else F.timestamp_seconds(
        F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(_YEAR_2100)))
    rows = named.select(
        F.col("page_id").cast("long").alias("page_id"),
        _encoded(F.col("url").cast("string")).alias("url"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("body_key", F.sha2(F.col("body").cast("binary"), 256))
    size = F.octet_length("body")
    first = kept(
        rows.filter(size >= min_bytes).groupBy("body_key")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1").drop("copies"), "repeated-bodies")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    cut = F.split(F.col("body"), r"(?<=WARC/)(?=1\.1\r\n)")
    chunks = F.concat(F.concat_ws("", F.transform(cut, lambda c: F.concat(
        F.hex(F.octet_length(c)), F.lit("\r\n"), c, F.lit("\r\n")))), F.lit("0\r\n\r\n"))
    chunked = F.contains(F.col("body"), F.lit(FIRST_LINE))
    coding = F.when(chunked, F.lit("Transfer-Encoding: chunked")).otherwise(
        F.concat(F.lit("Content-Length: "), size))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.when(revisit, F.concat(F.lit("Content-Length: "), size)).otherwise(coding),
                    F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(
        F.concat(http, F.when(chunked, chunks).otherwise(F.col("body"))))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    urn = lambda number: F.concat(
        F.lit(f"<{ID_HEAD}"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(FIRST_LINE),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.col("date")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(
            F.lit("sha1:"), _base32_sha1(F.col("body").cast("binary")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block")),
    )
    return rows.join(first, "body_key", "left").withColumn("block", block).select(
        F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0,
                   captured: str | None = None) -> None:
    """Archives in a folder, one for each task; nothing may lie there yet."""
    records(pages, min_bytes, captured).write.option("lineSep", RECORD_END).text(path)


def url_key(url: str | None) -> str:
    """The address by which captures are ordered: the host from its end, then path and query."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", url or "").removeprefix("//").split("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.|:(80|443)?$", "", host.rpartition("@")[2].lower())
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (slash or "/") + path


def _body(block: bytes, revisit: bool) -> tuple[bytes, int]:
    """The body that an HTTP response carries, and the length its head gives."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = head.lower()
    if b"\r\ntransfer-encoding: chunked" in fields and not revisit:
        parts, at = [], 0
        while True:
            end = body.index(b"\r\n", at)
            size = int(body[at:end].split(b";")[0], 16)
            if not size:
                break
            parts.append(body[end + 2:end + 2 + size])
            at = end + 4 + size
        whole = b"".join(parts)
        return whole, len(whole)
    said = re.search(rb"\r\ncontent-length:\s*(\d+)", fields)
    return body, int(said[1]) if said else len(body)


def parse_record(record: bytes) -> tuple:
    """The capture that a record, without its first line, tells of."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for part in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = part.partition(":")
        fields[name.lower()] = value.strip()
    block = rest[:int(fields["content-length"])]
    kind = fields["warc-type"]
    body, size = _body(block, kind == "revisit")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    intact = len(block) == int(fields["content-length"])
    if kind != "revisit":
        own = base64.b32encode(hashlib.sha1(body).digest()).decode()
        intact = intact and own == digest and size == len(body)
        digest, size = own, len(body)

    def number(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(ID_HEAD)
        return int(text) if re.fullmatch(r"-?\d+", text) else None

    url = fields.get("warc-target-uri")
    return (url_key(url), fields["warc-date"], number("warc-record-id"), url, kind,
            number("warc-refers-to"), size, digest, intact)


def _batch(rows: Sequence[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of all archives in a folder, as in ``CAPTURE``."""
    ship_package(spark)
    names = [part.split()[0] for part in CAPTURE.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]]
             for part in CAPTURE.split(", ")]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([parse_record(r.as_py()) for r in batch.column(0)], names, kinds)

    pieces = spark.read.option("lineSep", FIRST_LINE).text(path).filter(F.octet_length("value") > 0)
    return pieces.select(F.col("value").cast("binary").alias("record")).mapInArrow(parsed, CAPTURE)


class LoserTree:
    """Merges sorted lists: each inner node remembers the loser of its match, the root the winner.

    Only the matches on the path of the last winner are played again.
    """

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.losers = [0] * self.leaves
        winner = [*range(self.leaves)]
        above = self.leaves
        while above > 1:  # from the leaves up, level by level
            above //= 2
            played = []
            for i in range(above):
                a, b = winner[2 * i], winner[2 * i + 1]
                first, second = (b, a) if self._before(b, a) else (a, b)
                self.losers[above + i] = second
                played.append(first)
            winner = played
        self.winner = winner[0]

    def _head(self, run: int) -> tuple | None:
        if run < len(self.runs) and self.at[run] < len(self.runs[run]):
            return self.runs[run][self.at[run]]
        return None

    def _before(self, a: int, b: int) -> bool:
        one, other = self._head(a), self._head(b)
        if one is None or other is None:
            return one is not None
        return (one, a) < (other, b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) of each entry, in order of all."""
        while self._head(self.winner) is not None:
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (self.leaves + run) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's captures, run after run, in the order of all of them."""
    held = [batch for batch in batches if batch.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    keys = [(key.encode(), time, number is None, number or 0) for key, time, number in zip(
        *(table[name].to_pylist() for name in ("url_key", "captured", "page_id")))]
    of_run = table["run"].to_pylist()
    starts = [i for i, run in enumerate(of_run) if not i or run != of_run[i - 1]]
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)])]
    order = [starts[run] + at for run, at in LoserTree(runs)]
    yield from table.drop_columns(["run", "place"]).take(order).to_batches(max_chunksize=10_000)


def capture_histories(captures: DataFrame) -> DataFrame:
    """All captures in order of URL key, time and id, partition after partition."""
    ship_package(captures.sparkSession)
    order = ["url_key", "captured", F.asc_nulls_last("page_id")]
    runs = kept(captures.sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("place")),
        "capture-runs")
    ranges = -(-runs.count() // RANGE_CAPTURES) or 1
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", "place")
    return dealt.mapInArrow(_merged, captures.schema)


def resolved(histories: DataFrame) -> DataFrame:
    """Revisits with size and digest of the response they refer to; their own if it is missing."""
    whole = histories.filter("record_type != 'revisit'")
    response = whole.filter("page_id is not null").groupBy(F.col("page_id").alias("response_id")).agg(
        F.max_by(F.struct("payload_bytes", "payload_digest"), F.col("payload_bytes")).alias("found"))
    revisits = histories.filter("record_type = 'revisit'").join(
        response, F.col("refers_to") == F.col("response_id"), "left")
    found = {name: F.coalesce(F.col(f"found.{name}"), F.col(name)).alias(name)
             for name in ("payload_bytes", "payload_digest")}
    return whole.unionByName(revisits.select(
        *(found.get(name, F.col(name)) for name in histories.columns)))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages through archives in the shared folder and back: one row for each, from its history."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/kept/archives-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    histories = kept(capture_histories(read_archives(spark, path)), "capture-histories")
    return resolved(histories)


def sql() -> str:
    """What the archives must tell, computed from the pages, for DuckDB."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(
        f"substr('{alphabet}', (((('0x' || substr(h, {5 * part + 1}, 5))::INTEGER) >> {shift}) & 31) + 1, 1)"
        for part in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM bodies"""
