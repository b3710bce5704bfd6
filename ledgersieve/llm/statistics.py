"""Counts of a whole text that labellers and rules are built on."""

from __future__ import annotations

import numpy as np

from ledgersieve.llm.common import words

#: Characters that count as symbols (fixed by the contract of the rules' query).
SYMBOLS = "#*$%&|<>"
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct_words", "n_top_word", "n_lines",
)
_SYMBOL_CODES = np.frombuffer(SYMBOLS.encode(), np.uint8)
_SPACE_CODES = np.array([9, 10, 11, 12, 13, 32])
_MARK_CODES = np.frombuffer(b"!?;:", np.uint8)


def repeated_positions(codes: np.ndarray, width: int = 3) -> int:
    """Positions covered by a window of ``width`` codes that occurs at least twice."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    window, kinds = codes[:n], int(codes.max()) + 1
    for shift in range(1, width):
        if int(window.max()) >= 2**62 // kinds:
            window = np.unique(window, return_inverse=True)[1]
        window = window * kinds + codes[shift:shift + n]
    ordered = np.sort(window)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    edges = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(np.isin(window, again))
    edges[starts] += 1
    edges[starts + width] -= 1
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts in NAMES; a null text counts as empty."""
    data = (text or "").encode("utf-8", "replace")
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(by_byte[0x80:0xC0].sum())
    own = words(text)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in own), np.int64, len(own))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    return (
        len(own),
        points - int(by_byte[_SPACE_CODES].sum()),
        int(by_byte[_SYMBOL_CODES].sum()),
        len(lines) - len(set(lines)),
        repeated_positions(ids),
        int(by_byte[65:91].sum()),
        int(by_byte[65:91].sum() + by_byte[97:123].sum() + by_byte[0xC0:].sum()),
        int(by_byte[48:58].sum()),
        int(by_byte[_MARK_CODES].sum()),
        len(codes),
        int(np.bincount(ids).max()) if own else 0,
        len(lines),
    )
