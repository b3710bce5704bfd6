"""SentencePiece encoding and decoding with forward states shared between words.

A text is marked (spaces become the word mark, one stands before the text) and cut into
marked words. The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order: the forward states of the prefix that a word shares with the one before
are reused, and only the rest is walked. Words met before are remembered, within a bound.

The forward state of a prefix is its best segmentation, kept as the last piece. In a unigram
model that is the piece with the highest sum of scores (Viterbi). In a BPE model it is the
one piece whose border with the piece before no merge would cross: merging the whole word
gives exactly the sequence of which every two neighbours pass that test, so this is the
library's result, where summing scores would not be. Characters that no piece holds are
written as byte pieces, or as the unknown piece in a model without them.

Defined results: null and empty texts have no pieces; decoding gives back the text (the word
mark itself comes back as a space, and unknown characters as the unknown sign in a model
without byte pieces); repeated rows give repeated results; a null doc_id stays null; other
columns are ignored; an empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from ledgersieve.llm.common import map_texts, pick, vocabulary

MARK = "▁"
UNKNOWN_SIGN = " ⁇ "
REMEMBERED = 600_000
NORMAL, UNKNOWN, USER, BYTE, UNIGRAM, BPE = 1, 2, 4, 6, 1, 2
_NEVER = float("inf")


class PieceCoder:
    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("Only models that leave characters and spaces as they are can be used.")
        self._set([(p.piece, p.score, p.type) for p in model.pieces],
                  model.trainer_spec.model_type, rules.add_dummy_prefix)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True) -> PieceCoder:
        """A coder of (piece, score, type) rows, without a file."""
        coder = cls.__new__(cls)
        coder._set(pieces, kind, prefix)
        return coder

    def _set(self, pieces: list[tuple[str, float, int]], kind: int, prefix: bool) -> None:
        if kind not in (UNIGRAM, BPE):
            raise ValueError("Only unigram and BPE models can be used.")
        self.kind, self.prefix = kind, prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.cost = {p: -s for p, s, t in pieces if t in (NORMAL, USER)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.strange = max(self.cost.values(), default=0.0) + 10
        self.back = [bytes([int(p[3:5], 16)]) if t == BYTE else UNKNOWN_SIGN.encode() if t == UNKNOWN
                     else p.encode() if t in (NORMAL, USER) else b"" for p, _, t in pieces]
        letters = {c for p in self.ids for c in p}
        apart = "".join(re.escape(c) for c in map(chr, range(32)) if c not in letters)
        other = f"[{apart}]" if apart else "(?!)"
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile("(?s).+" if inside else
                              f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|{other}")
        #: Pieces read from their last letter to the first; "" leads to a whole piece.
        self.endings: dict = {}
        for p in self.ids:
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        self.spines: dict[str, tuple | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.coded: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, word: str, trail: list[str] | None = None) -> list[str]:
        """Pieces of a word by merging its cheapest pair again and again, the leftmost first."""
        symbols: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                pair = symbols[i] + symbols[after[i]]
                if pair in self.cost:
                    heapq.heappush(heap, (self.cost[pair], i, pair))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if symbols[i] is None or after[i] >= len(symbols) or symbols[i] + symbols[after[i]] != pair:
                continue
            if trail is not None:
                trail.append((symbols[i], symbols[after[i]]))
            symbols[i], symbols[after[i]] = pair, None
            after[i] = after[after[i]]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def _edges(self, piece: str) -> tuple | None:
        """(symbol, made at, used at) down the piece's right and left edge; None if never made."""
        if piece not in self.spines:
            trail: list[tuple[str, str]] = []
            if len(self.merged(piece, trail)) > 1:
                self.spines[piece] = None
            else:
                sides = []
                for side in (1, 0):
                    chain, end = [], _NEVER
                    symbol = piece
                    for pair in reversed(trail):
                        whole = pair[0] + pair[1]
                        if whole == symbol and (piece.endswith if side else piece.startswith)(whole):
                            chain.append((symbol, self.cost[symbol], end))
                            symbol, end = pair[side], self.cost[whole]
                    sides.append([*chain, (symbol, -_NEVER, end)])
                self.spines[piece] = tuple(sides)
        return self.spines[piece]

    def beside(self, a: str, b: str) -> bool:
        """Whether merging a + b ends with a and b: no merge crosses the border between them."""
        right, left = self._edges(a)[0], self._edges(b)[1]
        i = j = 0
        while True:
            (x, x_made, x_used), (y, y_made, y_used) = right[i], left[j]
            price = self.cost.get(x + y)
            if price is not None and price < x_used and price <= y_used:
                return False
            if i + 1 == len(right) and j + 1 == len(left):
                return True
            if j + 1 == len(left) or (i + 1 < len(right) and x_made >= y_made):
                i += 1
            else:
                j += 1

    def _forward(self, word: str, states: list[tuple[str, int, float]]) -> None:
        """Append the state of every prefix longer than those that ``states`` has.

        A state is the last piece, where it starts, and the cost of all pieces so far.
        """
        best = self._cheapest if self.kind == UNIGRAM else self._unmerged
        for end in range(len(states), len(word) + 1):
            ending = []  # pieces that end here, the shortest first, and where they start
            node, start = self.endings, end
            while start:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                if "" in node:
                    ending.append((node[""], start))
            piece, start, total = best(word[end - 1], end, ending, states)
            states.append((piece, start, total))

    def _traced(self, states: list[tuple[str, int, float]]) -> bytes:
        """The ids of a word from the states of all its prefixes, read from its end."""
        out, end = [], len(states) - 1
        while end:
            piece, end, _ = states[end]
            coded = self.coded.get(piece)
            if coded is None:
                coded = self.coded[piece] = self._ids([piece])
            out.append(coded)
        out.reverse()
        return b"".join(out)

    def _cheapest(self, letter, end, ending, states) -> tuple[str, int, float]:
        """Of the pieces that end here, the one with the highest sum of scores."""
        options = [(states[start][2] + self.cost[piece], piece, start) for piece, start in ending]
        if letter not in self.cost:
            options.append((states[end - 1][2] + self.strange, letter, end - 1))
        total, piece, start = min(options, key=lambda option: option[0])
        return piece, start, total

    def _unmerged(self, letter, end, ending, states) -> tuple[str, int, float]:
        """The piece that ends here and whose border no merge crosses."""
        fits = self.fits
        for piece, start in reversed(ending):
            pair = states[start][0], piece
            good = fits.get(pair)
            if good is None:
                good = fits[pair] = bool(self._edges(piece)) and (
                    pair[0] not in self.cost or self.beside(*pair))
            if good:
                return piece, start, 0.0
        return letter, end - 1, 0.0

    def _ids(self, pieces: list[str]) -> bytes:
        out = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode distinct words, depth-first through the trie that their order spells."""
        states: list[tuple[str, int, float]] = [("", 0, 0.0)]
        last = ""
        for word in sorted(words):
            if self.kind == BPE and word.startswith(MARK * 2):
                self.known[word] = self._ids(self.merged(word))  # marks merge at equal scores
                continue
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1:]
            self._forward(word, states)
            self.known[word] = self._traced(states)
            last = word

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each whole text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.fits) > 2 * REMEMBERED:
            self.fits.clear()
        start = MARK if self.prefix else ""
        found = [self.cut.findall(start + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh: set[str] = set()
        for words in found:
            fresh.update(set(words).difference(self.known))
        self.learn(list(fresh))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32) for words in found]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.back.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the piece ids of each row's text, and whether they decode to it again."""
    file = vocabulary(docs.sparkSession, path)

    def start():
        coder = PieceCoder(file.value)

        def work(texts):
            coded = coder.encode(texts)
            return [coded, [coder.decode(ids.tolist()) == (t or "").replace(MARK, " ")
                            for ids, t in zip(coded, texts, strict=True)]]
        return work

    return map_texts(pick(docs, "doc_id", "text"), ["doc_id"], "ids array<int>, same_text boolean", start)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number and digest of the ids, and whether decoding them gives the text back.

    ``ids_sha256`` is taken over the ids as little-endian 32-bit numbers, ``text_sha256`` over
    the decoded text.
    """
    file = vocabulary(docs.sparkSession, path)

    def start():
        coder = PieceCoder(file.value)

        def work(texts):
            coded = coder.encode(texts)
            texts_again = [coder.decode(ids.tolist()) for ids in coded]
            return [
                [len(ids) for ids in coded],
                [hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() for ids in coded],
                [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts_again],
                [a == (b or "").replace(MARK, " ") for a, b in zip(texts_again, texts, strict=True)],
            ]
        return work

    return map_texts(pick(docs, "doc_id", "text"), ["doc_id"],
                     "n_pieces long, ids_sha256 string, text_sha256 string, same_text boolean", start)
