"""Token ids packed into rows of one length, for training on binary matrices.

Each task streams its documents: a text is encoded and closed with an end token, cut into
pieces of at most ``length`` ids without losing any, and pieces are held up to
``buffer_tokens`` ids. A full buffer is packed by best-fit decreasing: pieces by falling
length, each into the open row with the least room that still holds it, found by a segment
tree over room sizes. Packing needs no shuffle and a task's memory is bounded; a lost task is
done again from its input.

One output row is one packed row: the ids as little-endian numbers of a fixed width (padded
with the end token), the cumulative segment lengths, the positions that start again at 0 in
every segment (padding has position 0), and which document and which of its pieces each
segment is: its id, a number that no other input row has, and the piece's number. Joining the
pieces of a row by number gives its ids back, also where ids repeat or are null.

Defined results: a null or empty text is one segment that holds the end token only; repeated
rows are packed as often as they occur; a null doc_id is kept as null; other columns are
ignored; an empty table gives no rows; texts of any length are cut, none is dropped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgersieve.llm.common import pick, slices, vocabulary
from ledgersieve.shipping import ship_package

#: Fixed value: how byte-level BPE cuts a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = """row_id string, ids binary, positions binary, cu_seqlens array<int>,
            doc_ids array<{}>, doc_rows array<long>, pieces array<int>, n_tokens int"""
#: Runs of white space from this length on are encoded by themselves.
LONG_RUN = 2_000


@dataclass(frozen=True)
class PackingConfig:
    length: int = 2048
    buffer_tokens: int = 2_000_000
    #: ids below 65,536 fit two bytes
    id_type: str = "<u2"


class RoomTree:
    """Rows by the room they have left: a segment tree that finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << max(length, 1).bit_length()
        self.count = [0] * (2 * self.size)  # rows in each range of room sizes
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the row with the least room of at least ``need``."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Places of the pieces in each row: best-fit decreasing, ties in the order given."""
    tree, rows = RoomTree(length), []
    for place in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[place])
        if found is None:
            found = (length, len(rows))
            rows.append([])
        room, row = found
        rows[row].append(place)
        if room > sizes[place]:
            tree.add(room - sizes[place], row)
    return rows


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    coder = tiktoken.Encoding("packing", pat_str=PRE_TOKEN, mergeable_ranks=table, special_tokens={})
    return coder, max(table.values()) + 1


def encoded(coder, text: str) -> list[int]:
    """Token ids of a text, as ``encode_ordinary`` gives them where it can.

    Its pattern needs stack for every blank of a run. A long run is one piece, without its last
    character if more follows (which may begin the next piece), so texts are cut around it.
    """
    ids: list[int] = []
    at = 0
    for run in re.finditer(rf"\s{{{LONG_RUN},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += coder.encode_ordinary(text[at:run.start()])
        ids += coder._encode_single_piece(text[run.start():end])
        at = end
    return ids + coder.encode_ordinary(text[at:])


def _pack(held: list[tuple], cfg: PackingConfig, end: int, where: str) -> list[tuple]:
    out = []
    for number, places in enumerate(best_fit([len(piece[-1]) for piece in held], cfg.length)):
        ids = np.full(cfg.length, end, cfg.id_type)
        positions = np.zeros(cfg.length, "<u4")
        at, edges = 0, [0]
        for place in places:
            piece = held[place][-1]
            ids[at:at + len(piece)] = piece
            positions[at:at + len(piece)] = np.arange(len(piece))
            at += len(piece)
            edges.append(at)
        out.append((f"{where}-{number}", ids.tobytes(), positions.tobytes(), edges,
                    *([held[p][field] for p in places] for field in range(3)), at))
    return out


def pack(docs: DataFrame, path: str, cfg: PackingConfig = PackingConfig()) -> DataFrame:
    """Packed rows of all documents, by a file of byte-pair ranks."""
    ship_package(docs.sparkSession)
    file: Broadcast = vocabulary(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(PACKED.format(kind))
    arrow = to_arrow_schema(schema)
    if cfg.length < 1:
        raise ValueError("A row holds at least one id.")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, buffers = TaskContext.get().partitionId(), 0
        coder, end = encoder(file.value)
        if end > np.iinfo(cfg.id_type).max:
            raise ValueError(f"Ids up to {end} don't fit {cfg.id_type}.")
        held, tokens, row = [], 0, task << 33
        for rows in batches:
            names, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for a, b in slices(texts):
                for name, text in zip(names[a:b], texts[a:b], strict=True):
                    ids = np.array([*encoded(coder, text or ""), end], cfg.id_type)
                    for number, start in enumerate(range(0, len(ids), cfg.length)):
                        held.append((name, row, number, ids[start:start + cfg.length]))
                        tokens += len(held[-1][-1])
                        if tokens >= cfg.buffer_tokens:
                            yield batch(_pack(held, cfg, end, f"{task}-{buffers}"))
                            held, tokens, buffers = [], 0, buffers + 1
                    row += 1
        if held:
            yield batch(_pack(held, cfg, end, f"{task}-{buffers}"))

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: one binary row of ``length`` ids each."""
    packed.write.parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """Packed rows with digests in place of the matrices."""
    return packed.select("row_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("positions", 256).alias("positions_sha256"),
                         "cu_seqlens", "doc_ids", "doc_rows", "pieces")


def unpack(ids: bytes, cu_seqlens: list[int], id_type: str = "<u2") -> list[np.ndarray]:
    """The segments of one packed row."""
    row = np.frombuffer(ids, id_type)
    return [row[a:b] for a, b in zip(cu_seqlens, cu_seqlens[1:])]
