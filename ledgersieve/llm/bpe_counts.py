"""Token counts of byte-level BPE without a tokenizer library.

Texts are cut into pre-tokens, whose distinct forms of a batch are held as ragged arrays:
one flat array of symbols and one of the pre-token each belongs to. In every round all pairs
are ranked at once, each pre-token's lowest-ranked pair is merged wherever it stands, and
rounds go on until nothing merges; the symbols that are left are counted. A rule that uses a
symbol always ranks after the rule that makes it, so merging every place of the lowest pair
at once equals merging them one by one.

Pre-tokens of more than LONG bytes would need a round for each rank they meet; they are
merged one place at a time from a heap, with the same result.

Defined results: null and empty texts have 0 bytes and 0 tokens; the strings of added tokens
inside a text count as one token each, as the library does by default; repeated rows give
repeated results; a null doc_id stays null; other columns are ignored; an empty table gives
an empty result. Whole texts are counted, whatever their length.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from ledgersieve.llm.common import map_texts, pick, vocabulary

#: Fixed value: how byte-level BPE cuts a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 2000
REMEMBERED = 400_000
NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BpeCounter:
    """Counts tokens by the merge rules of a tokenizer file in JSON."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pieces = spec["model"]["vocab"]
        left, right, made = (np.array([pieces[x] for x in side], np.int64) for side in (
            [m[0] for m in merges], [m[1] for m in merges], [m[0] + m[1] for m in merges]))
        self.base = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.base[byte] = pieces[letter]
        keys, first = np.unique(left << 32 | right, return_index=True)
        # an open-addressing table: rank and product of each pair
        self.bits = max(int(len(keys) * 4 - 1).bit_length(), 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NEVER, np.int32)
        self.made = made
        places, waiting, ranks = self._place(keys), np.arange(len(keys)), first.astype(np.int32)
        while len(waiting):
            free = self.keys[places] == -1
            self.keys[places[free]] = keys[waiting[free]]  # the last writer of a place wins it
            won = self.keys[places] == keys[waiting]
            self.rank[places[won]] = ranks[waiting[won]]
            waiting, places = waiting[~won], (places[~won] + 1) & ((1 << self.bits) - 1)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) \
            if added else None
        self.cut = regex.compile(PRE_TOKEN)
        self.known: dict[str, int] = {}

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return mixed.astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where no rule merges it."""
        places = self._place(keys)
        out = np.where(self.keys[places] == keys, self.rank[places], NEVER)
        open_ = np.flatnonzero((self.keys[places] != keys) & (self.keys[places] != -1))
        places = places[open_]
        while len(open_):
            places = (places + 1) & ((1 << self.bits) - 1)
            hit = self.keys[places] == keys[open_]
            out[open_[hit]] = self.rank[places[hit]]
            on = ~hit & (self.keys[places] != -1)
            open_, places = open_[on], places[on]
        return out

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that each non-empty pre-token ends with."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.base[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        counts = np.zeros(len(tokens), np.int64)
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NEVER, np.int32)  # of the pair that starts here
            at = np.flatnonzero(inside)
            rank[at] = self.ranks(symbols[at] << 32 | symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = lowest == NEVER
            counts[owner[starts[done]]] = lengths[done]
            hit = (rank == np.repeat(lowest, lengths)) & (rank != NEVER)
            # of overlapping places (aaa) every other one merges, from the left
            place = np.flatnonzero(hit)
            if len(place):
                fresh = np.r_[True, np.diff(place) > 1]
                run = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
                place = place[(place - run) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            stay = ~np.repeat(done, lengths)
            stay[place + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def merge_long(self, token: bytes) -> int:
        """Symbols left of one long pre-token, merged one place at a time."""
        symbols = self.base[np.frombuffer(token, np.uint8)].tolist()
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rule = dict(zip(self.keys[self.keys >= 0].tolist(), self.rank[self.keys >= 0].tolist()))
        pair = lambda i: rule.get(symbols[i] << 32 | symbols[after[i]], NEVER)
        heap = [(pair(i), i) for i in range(len(symbols) - 1)]
        heap = [x for x in heap if x[0] != NEVER]
        heapq.heapify(heap)
        left = len(symbols)
        while heap:
            rank, i = heapq.heappop(heap)
            if symbols[i] < 0 or after[i] >= len(symbols) or pair(i) != rank:
                continue
            gone = after[i]
            symbols[i], symbols[gone] = int(self.made[rank]), -1
            after[i] = after[gone]
            if after[i] < len(symbols):
                before[after[i]] = i
            left -= 1
            for j in (before[i], i):
                if j >= 0 and after[j] < len(symbols) and pair(j) != NEVER:
                    heapq.heappush(heap, (pair(j), j))
        return left

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        found, added, fresh = [], [], set()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for text in texts:
            parts = [text or ""]
            if self.added is not None and self.added.search(parts[0]):
                parts = self.added.split(parts[0])
            tokens = self.cut.findall(parts[0])
            for part in parts[1:]:
                tokens += self.cut.findall(part)
            found.append(tokens)
            added.append(len(parts) - 1)
            fresh.update(set(tokens).difference(known))
        fresh = list(fresh)
        coded = [t.encode("utf-8", "replace") for t in fresh]
        short = [i for i, t in enumerate(coded) if len(t) <= LONG]
        known.update(zip((fresh[i] for i in short), self.merge([coded[i] for i in short]).tolist()))
        known.update((fresh[i], self.merge_long(t)) for i, t in enumerate(coded) if len(t) > LONG)
        return [n + sum(map(known.__getitem__, tokens))
                for n, tokens in zip(added, found, strict=True)]


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of ``docs``."""
    file = vocabulary(docs.sparkSession, path)

    def start():
        counter = BpeCounter(file.value)

        def work(texts):
            tokens = counter.count(texts)
            return [[len((t or "").encode("utf-8", "replace")) for t in texts], tokens,
                    [n > limit for n in tokens]]
        return work

    return map_texts(pick(docs, "doc_id", "text"), ["doc_id"],
                     "n_bytes long, n_tokens long, over_limit boolean", start)
