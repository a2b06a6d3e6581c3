"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece of text there is exactly one token that can end
the encoding of that prefix. It is stored per prefix: encoding walks the table
backwards, appending bytes extends it, and an edit recomputes it only from the
edit to where old and new entries agree again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailcast.llm.common import steps

#: Pieces of text, prefixes, and pairs of tokens that a Python worker remembers.
CACHE_PIECES = CACHE_PREFIXES = CACHE_PAIRS = 300_000
#: Pieces of at most so many bytes share what is known of their prefixes.
SHARED_BYTES = 64


class Vocabulary:
    """The ranks of a byte-level BPE, read from lines of base64 token and rank."""

    def __init__(self, lines: bytes) -> None:
        self.rank = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x)}
        self.token = dict(sorted((r, t) for t, r in self.rank.items()))
        self.longest = max(map(len, self.rank))
        self.suffixes = {t[i:] for t in self.rank for i in range(len(t))}
        self._joint: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._follows: dict[int, bool] = {}
        for r, t in self.token.items():  # by rank: parts come before what they form
            for k in range(1, len(t)):
                left, right = self.rank.get(t[:k]), self.rank.get(t[k:])
                if left is not None and right is not None and left < r and right < r and self._unmerged(left, right):
                    self._parts[r] = (left, right)
                    self._joint[left, right] = r
                    break

    def _unmerged(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side: undoing merges
        from the latest, no merge across the border may come before the one undone.
        Of equal ranks the one further left is done first."""
        before = None
        while True:
            across = self._joint.get((left, right))
            if across is not None and (before is None or across < before):
                return False
            a, b = self._parts.get(left), self._parts.get(right)
            if a and (left > right or not b):
                before, left = left, a[1]
            elif b:
                before, right = right + 1, b[0]
            else:
                return True

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can come straight after ``left`` in an encoding."""
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= CACHE_PAIRS:
                self._follows.clear()
            known = self._follows[key] = self._unmerged(left, right)
        return known


class Prefixes:
    """The last token of each non-empty prefix of ``data``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last(self, data: bytes, last: list[int], end: int) -> int:
        v, found = self.vocabulary, []
        for start in range(end - 1, max(-1, end - 1 - v.longest), -1):
            x = data[start:end]
            if x not in v.suffixes:
                break
            if (r := v.rank.get(x)) is not None:
                found.append((start, r))
        for start, r in reversed(found):
            if not start or v.follows(last[start - 1], r):
                return r
        raise ValueError("the vocabulary lacks single bytes")

    def append(self, data: bytes) -> None:
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last(self.data, self.last, end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replace the bytes from ``start`` to ``stop``; returns how many entries were
        worked out again. Entries depend on those up to the longest token before, so
        a run of so many unchanged ones ends the work."""
        new = self.data[:start] + data + self.data[stop:]
        last, shift, same = self.last[:start], stop - start - len(data), 0
        while len(last) < len(new):
            end = len(last) + 1
            last.append(self._last(new, last, end))
            old = end + shift
            same = same + 1 if end > start + len(data) + self.vocabulary.longest and self.last[old - 1] == last[-1] else 0
            if same >= self.vocabulary.longest:
                done = len(last) - start
                self.data, self.last = new, last + self.last[old:]
                return done
        done = len(last) - start
        self.data, self.last = new, last
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """Packed ids of pieces of text, worked out when first asked for. Short pieces share
    a table of last tokens by prefix, filled only where an encoding leads."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self._last: dict[bytes, int] = {}
        self._packed = {r: r.to_bytes(4, "little") for r in vocabulary.token}

    def last(self, prefix: bytes) -> int:
        known = self._last.get(prefix)
        if known is None:
            rank = self.vocabulary.rank
            known = rank.get(prefix)
            start = 0
            while known is None:  # the longest token that can end here is the one
                start += 1
                token = rank.get(prefix[start:])
                if token is not None and self.vocabulary.follows(self.last(prefix[:start]), token):
                    known = token
            self._last[prefix] = known
        return known

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > SHARED_BYTES:
            return np.array(Prefixes(self.vocabulary, data).ids(), dtype="<u4").tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(self._last) >= CACHE_PREFIXES:
            self._last.clear()
        ids, end = [], len(data)
        while end:
            token = self.last(data[:end])
            ids.append(self._packed[token])
            end -= len(self.vocabulary.token[token])
        packed = self[piece] = b"".join(reversed(ids))
        return packed


_loaded: dict[bytes, tuple[Vocabulary, _Pieces]] = {}


def load(lines: bytes) -> tuple[Vocabulary, _Pieces]:
    """A vocabulary with its remembered pieces, once in each process."""
    key = hashlib.sha256(lines).digest()
    if key not in _loaded:
        v = Vocabulary(lines)
        _loaded[key] = v, _Pieces(v)
    return _loaded[key]


def encode_text(text: str, pieces: _Pieces, pattern: regex.Pattern) -> bytes:
    """Ids of each match of ``pattern``, as little-endian unsigned 32-bit integers."""
    return b"".join([pieces[x] for x in pattern.findall(text)])


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", n: str = "n_tokens") -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit) and ``n`` (long) for the
    whole texts. Row by row, with no shuffle; rows are neither joined nor dropped.

    Null and empty texts get no ids. Special tokens' strings are ordinary text.
    Columns named like the results are replaced; others pass through as they are.
    ``vocabulary`` is the path of a rank file on the driver, sent to tasks (under
    1 MB); a text's memory is a few times its size.
    """
    with open(vocabulary, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(ids, n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces = load(lines.value)
        split = regex.compile(pattern)
        for rows, texts in steps(batches, text):
            packed = [encode_text(x.decode(), pieces, split) for x in texts]
            yield _with(rows, **{ids: pa.array(packed, pa.binary()), n: pa.array([len(x) // 4 for x in packed], pa.int64())})

    return docs.mapInArrow(run, docs.withColumns({ids: F.lit(b""), n: F.lit(0).cast("long")}).schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` (binary), the bytes of packed ``ids``; null ids give none."""
    with open(vocabulary, "rb") as f:
        lines = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = encoded.drop(decoded)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = load(lines.value)[0].token
        for rows, packed in steps(batches, ids):
            out = [b"".join([token[i] for i in np.frombuffer(x, dtype="<u4").tolist()]) for x in packed]
            yield _with(rows, **{decoded: pa.array(out, pa.binary())})

    return encoded.mapInArrow(run, encoded.withColumns({decoded: F.lit(b"")}).schema)
