"""Per-word model scores with a memo: each distinct word of a worker is scored once, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: ASCII punctuation and digits, which word models leave out.
DROPPED = b"0123456789" + bytes(c for c in range(33, 127) if not chr(c).isalnum())
PIECE = 1 << 18


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a lower-cased text without ASCII punctuation and digits."""
    return data.translate(None, DROPPED).split() if data else []


def joined(words: list[bytes], before: bytes, after: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words between markers in one byte array, each word's start there, and its length without markers."""
    flat = np.frombuffer(b"".join([before + w + after for w in words]), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + len(before) + len(after))
    return flat, ends - lengths - len(before) - len(after), lengths


class WordTable:
    """Word bytes -> row of a score table; ``score`` maps a list of words to an array of rows."""

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], limit: int = 400_000):
        self.score, self.limit = score, limit
        self.places: dict[bytes, int] = {}
        self.rows = score([b"a"])[:0]

    def index(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The table rows of every text's words. Rows stay valid until the next call."""
        if len(self.places) > self.limit:
            self.places.clear()
            self.rows = self.rows[:0]
        places, out, waiting, held = self.places, [], [], 0
        new: list[np.ndarray] = [self.rows]
        size = len(self.rows)

        def flush() -> None:
            nonlocal size
            unknown = list({w for words in waiting for w in words if w not in places})
            for at in range(0, len(unknown), 1 << 16):
                part = unknown[at : at + (1 << 16)]
                new.append(self.score(part))
                places.update(zip(part, range(size, size + len(part))))
                size += len(part)
            out.extend(np.fromiter(map(places.__getitem__, words), np.int32, len(words)) for words in waiting)
            waiting.clear()

        for text in texts:
            waiting.append(words_of(text))
            held += len(waiting[-1])
            if held > PIECE:
                flush()
                held = 0
        flush()
        self.rows = np.concatenate(new)
        return out
