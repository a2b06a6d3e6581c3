"""Line deduplication with fuzzy matches.

Each distinct word of a normalised line votes on the bits of one block only of the
line's SimHash, the block that the word's own hash names. So an edited word disturbs the
old word's block and the new one's and leaves the others as they are, however long the
line; were all words to vote on all bits, one word would turn several of 64. By the
pigeonhole principle some blocks of similar lines agree, and lines meet in tables keyed
by a block, or by two of five in lines of few words. Pairs are verified by edit similarity,
and of each connected group one occurrence stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailcast.llm.buckets import link, shared_only
from tailcast.llm.common import added_names, discard, id_bitmap, in_bitmap, mix, saved, small_side, steps, word_hashes

#: Edit similarity (1 less distance by longer length) that linked lines have at least.
SIMILAR = 0.9
#: Words on average in a block that is a key by itself, and the least such a block holds:
#: words enough that lines don't agree on them by chance.
BLOCK_WORDS, BLOCK_LEAST = 6, 5
#: The same for the two of five blocks that are a key together.
PAIR_LEAST = 4
#: Distinct words up to which a line's keys leave out one word each; range in which they are two of
#: five blocks; and from which they are one block. Ranges overlap, so that similar lines share one.
_FEW, _SOME, _MANY = 9, (9, 22), 20
#: Words of more bytes are cut where their content says so.
_LONG_WORD = 16
#: Bits of the whole line's SimHash that similar lines of ``_MANY`` words or more differ in at most;
#: by far more than their edits turn.
BITS = 26
_STEP = 1_000_000
#: Members of different components up to which a key's pairs are compared as they are.
SMALL = 32
#: Lines, and characters, of the blocks in which lines of larger keys are compared, about; pairs compared at a time.
_BLOCK, _BLOCK_CHARS, _PAIRS = 256, 1 << 20, 1 << 14
#: Characters of a run by which lines share an edit.
_RUN = 7
_ATTR = "struct<n: int, sim: long>"

#: Numbers of blocks that lines may have, each about 1.4 times the one before.
_RUNGS = [3]
while _RUNGS[-1] < 1 << 20:
    _RUNGS.append(max(_RUNGS[-1] + 1, int(_RUNGS[-1] * 1.4)))
#: A line's words may differ by so much from those of a similar one when the number of blocks is chosen.
_ROOM = 1.06

#: For a byte, its bits in eight lanes of a 64-bit integer.
_LANES = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], dtype=np.uint64)


def normalised(line: bytes) -> bytes:
    """A-Z lower-cased, white space as single spaces, none at the ends."""
    return b" ".join(line.lower().split())


def _votes(hashes: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes as 64 bytes each, in eight lanes."""
    return _LANES[mix(hashes).view(np.uint8).reshape(-1, 8)]


def _majority(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes from votes per bit [n, 64]: bits that more than half vote for."""
    return np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _summed(lanes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Votes per bit of runs of words; a run has fewer than 256."""
    return np.ascontiguousarray(np.add.reduceat(lanes, starts, axis=0)).view(np.uint8).reshape(len(starts), 64).astype(np.uint16)


def _blocks(line: np.ndarray, h: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words (ordered by line, then hash of 44 bits) of lines cut into ``blocks`` blocks: line, block,
    number of words and SimHash of each block that has any."""
    block = (h * blocks[line].astype(np.uint64)) >> np.uint64(44)
    edge = np.flatnonzero(np.diff(line, prepend=-1) | np.diff(block.astype(np.int64), prepend=-1))
    size = np.diff(np.append(edge, len(h)))
    return line[edge], block[edge].astype(np.int64), size, _majority(_summed(_votes(h), edge), size)


def fingerprints(lines: list[bytes], similarity: float = SIMILAR) -> tuple[np.ndarray, list[np.ndarray]]:
    """Whole-line SimHashes (int64; 0 where a line has fewer than ``_MANY`` distinct words) and, for
    each normalised line, the keys (int64) of the tables it is in."""
    sims, keys, ends, _ = _keyed(lines, similarity)
    return sims, np.split(keys, ends[:-1]) if lines else []


def _keyed(lines: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """SimHashes, keys of all lines in order, where each line's end, and the lines' numbers of characters."""
    length = np.array([len(x.decode()) for x in lines], dtype=np.int64)
    edits = ((1 - similarity) * length + 1e-9).astype(np.int64)
    owner, key = [], []

    def add(at: np.ndarray, *parts: np.ndarray | int) -> None:
        """Keys from parts: numbers of a table and hashes."""
        mixed = np.zeros(len(at), dtype=np.uint64)
        for p in parts:
            mixed = mix(mixed * np.uint64(0xD6E8FEB86659FD93) + (np.uint64(p) if isinstance(p, int) else p.astype(np.uint64)))
        owner.append(at), key.append(mixed)

    # one edit at most: similar lines are equal when some character is left out of either or both
    for i in np.flatnonzero(edits == 1):
        text = lines[i].decode()
        without = {text, *(text[:k] + text[k + 1 :] for k in range(len(text)))}
        add(np.full(len(without), i), 1, np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in without], dtype=np.uint64))

    words, first = word_hashes(lines, _LONG_WORD)
    packed = np.sort(np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(first)) << np.uint64(44) | words >> np.uint64(20))
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
    line, h = (packed >> np.uint64(44)).astype(np.int64), packed & np.uint64((1 << 44) - 1)
    n = np.bincount(line, minlength=len(lines))
    far = edits > 1

    few = far & (n <= _FEW)
    if few.any():
        one, hash_ = line[few[line]], h[few[line]]
        starts = np.flatnonzero(np.diff(one, prepend=-1))
        lanes, ids = _votes(hash_), one[starts]
        whole = _summed(lanes, starts)
        add(ids, 2, _majority(whole, n[ids]))
        nth = np.searchsorted(ids, one)
        left = whole[nth] - lanes.view(np.uint8).reshape(-1, 64)
        more = n[one] > 1
        add(one[more], 2, _majority(left, n[one] - 1)[more])

    some = far & (n >= _SOME[0]) & (n <= _SOME[1])
    if some.any():
        ids, cells, size, value = _blocks(line[some[line]], h[some[line]], np.full(len(lines), 5))
        names = np.flatnonzero(some)
        at = np.searchsorted(names, ids)
        table, held = np.zeros((len(names), 5), dtype=np.uint64), np.zeros((len(names), 5), dtype=np.int64)
        table[at, cells], held[at, cells] = value, size
        for k, (i, j) in enumerate(combinations(range(5), 2)):
            full = held[:, i] + held[:, j] >= PAIR_LEAST
            add(names[full], 3 + k, table[full, i], table[full, j])

    many = n >= _MANY
    sims = np.zeros(len(lines), dtype=np.uint64)
    if many.any():
        rungs = np.array(_RUNGS)
        low, high = (rungs[np.maximum(np.searchsorted(rungs, n * x / BLOCK_WORDS, side="right") - 1, 0)] for x in (1.0, _ROOM))
        one, hash_ = line[many[line]], h[many[line]]
        block = (hash_ * low[one].astype(np.uint64)) >> np.uint64(44)
        edge = np.flatnonzero(np.diff(one, prepend=-1) | np.diff(block.astype(np.int64), prepend=-1))
        counts, size, ids = _summed(_votes(hash_), edge), np.diff(np.append(edge, len(one))), one[edge]
        full = size >= BLOCK_LEAST
        add(ids[full], 13, low[ids[full]], block[edge][full], _majority(counts[full], size[full]))
        heads = np.flatnonzero(np.diff(ids, prepend=-1))
        sims[ids[heads]] = _majority(np.add.reduceat(counts, heads, axis=0, dtype=np.uint32), n[ids[heads]])
        again = many & (high > low)
        if again.any():
            ids, cells, size, value = _blocks(line[again[line]], h[again[line]], high)
            full = size >= BLOCK_LEAST
            add(ids[full], 13, high[ids[full]], cells[full], value[full])

    owners, keys = np.concatenate([np.zeros(0, np.int64), *owner]), np.concatenate([np.zeros(0, np.uint64), *key]).view(np.int64)
    return sims.view(np.int64), keys[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(lines))), length


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel over the band of diagonals that ``most`` edits can reach (Hyyrö), as a whole
    number; common ends are taken off first. A distance of more than ``most`` may be told as ``most + 1``, as soon as it is sure."""
    if len(a) < len(b):
        a, b = b, a
    most = len(a) if most is None else most
    lo = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    a, b = a[lo:], b[lo:]
    hi = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(b))
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    if len(b) > _LONG_LINE:
        if _unlike(a, b, most):
            return most + 1
        few = _few_edits(a, b, min(most, _FEW_EDITS))
        if few <= min(most, _FEW_EDITS) or most <= _FEW_EDITS:
            return few
    # ``most`` edits lead no farther from the corner's diagonal than this, on either side of both corners'
    beyond = (most - len(a) + len(b)) // 2
    width = len(a) - len(b) + 2 * beyond + 1
    whole, corner, distance = (1 << width) - 1, 1 << width - 1 - beyond, len(a) - len(b)
    up, down = whole >> beyond << beyond, 0
    step = max(width, 1024)
    for start in range(0, len(b), step):
        where: dict[str, int] = {}
        first = max(start - beyond, 0)
        for i, x in enumerate(a[first : start - beyond + width + step], first - start + beyond):
            where[x] = where.get(x, 0) | 1 << i
        for i, x in enumerate(b[start : start + step]):
            same = where.get(x, 0) >> i & whole
            flat = ((((same & up) + up) ^ up) | same | down) & whole
            if not flat & corner:
                distance += 1
                if distance > most:  # it never falls along a diagonal
                    return most + 1
            rise, fall = down | ~(flat | up) & whole, flat & up
            flat >>= 1
            up, down = fall | ~(flat | rise) & whole, flat & rise
    return distance


#: Characters from which on a pair is first tried by its runs and by few edits.
_LONG_LINE, _FEW_EDITS = 100_000, 300


def _unlike(a: str, b: str, most: int) -> bool:
    """Whether more than ``most`` edits are sure: each changes as many of the longer text's runs as these have characters at
    most. Runs are as long as leaves a fifth of them unchanged by all edits, so that unlike texts of the same words share fewer."""
    run = max(2, min(16, int(0.8 * len(a) / max(most, 1))))
    runs = [Counter(t[i : i + run] for i in range(len(t) - run + 1)) for t in (a, b)]
    return (runs[0] & runs[1]).total() < len(a) - run + 1 - most * run


def _few_edits(a: str, b: str, most: int) -> int:
    """The distance if it is at most ``most``, else ``most + 1``: how far each diagonal gets with each number of edits."""

    def along(i: int, j: int) -> int:
        step = 32
        while step and i < len(a) and j < len(b):
            if a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
            else:
                step //= 2
        return min(i, len(a), len(b) + i - j)

    reach = {0: along(0, 0)}
    if len(a) == len(b) == reach[0]:
        return 0
    for edits in range(1, most + 1):
        after = {}
        for k in range(-edits, edits + 1):  # the place in a less that in b
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            i = min(i, len(a), len(b) + k)
            if i >= max(0, k):
                after[k] = along(i, i - k)
                if after[k] == len(a) and len(a) - k == len(b):
                    return edits
        reach = after
    return most + 1


def similar(a: str, b: str, least: float) -> bool:
    longer = max(len(a), len(b))
    most = int(longer - least * longer + 1e-9)
    return edit_distance(a, b, most) <= most


#: Words of 64 diagonals up to which pairs are compared together, pairs from which on that takes less time than one by one,
#: and bytes of such a set's windows.
_BAND_WORDS, _TOGETHER, _WINDOWS = 8, 48, 1 << 17


def similar_all(xs: list[str], ys: list[str], least: float) -> np.ndarray:
    """``similar`` of each pair: those with bands of like width together, a step of all at a time."""
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(xs, ys, strict=True)]
    longer, shorter = (np.array([len(p[k]) for p in pairs], dtype=np.int64) for k in (0, 1))
    most = (longer - least * longer + 1e-9).astype(np.int64)
    good, words = np.zeros(len(pairs), dtype=bool), most // 64 + 1
    words[longer - shorter > most] = 0
    for n in np.unique(words[words > 0]).tolist():
        at = np.flatnonzero(words == n)
        at = at[np.argsort(shorter[at], kind="stable")]
        size = max(_TOGETHER, _WINDOWS // (64 * n))
        for part in np.split(at, range(size, len(at), size)):
            if n <= _BAND_WORDS and len(part) >= _TOGETHER:
                good[part] = _within([pairs[i][0] for i in part], [pairs[i][1] for i in part], most[part], n)
            else:
                good[part] = [edit_distance(*pairs[i], k) <= k for i, k in zip(part.tolist(), most[part].tolist(), strict=True)]
    return good


def _within(a: list[str], b: list[str], most: np.ndarray, words: int) -> np.ndarray:
    """Whether texts ``a`` are within ``most`` edits of ``b``, none of which is longer: the steps of ``edit_distance`` over bands
    of ``words`` 64-bit words for all pairs at once. Pairs that have passed their bound or their end are left out from time to time."""
    size, end = (np.array([len(x) for x in t], dtype=np.int64) for t in (a, b))
    codes = [np.frombuffer("".join(t).encode("utf-32-le"), dtype=np.uint32) for t in (a, b)]
    none = max(int(x.max(initial=0)) for x in codes) + 1
    distance, beyond, wide = size - end, (most - size + end) // 2, 64 * words
    corner = distance + beyond
    # a's characters where the window of step i begins at i; b's by steps
    x = np.full((len(a), int(end.max(initial=0)) + wide), none, dtype=np.min_scalar_type(none))
    y = np.full((int(end.max(initial=0)), len(a)), none, dtype=x.dtype)
    for table, code, n, first in ((x, codes[0], size, beyond), (y.T, codes[1], end, 0 * beyond)):
        table[np.repeat(np.arange(len(n)), n), np.arange(len(code)) - np.repeat(np.cumsum(n) - n - first, n)] = code
    low = beyond - 64 * np.arange(words)[:, None]
    up = np.where(low < 64, ~np.uint64(0) << np.clip(low, 0, 63).astype(np.uint64), np.uint64(0))
    down, one = np.zeros_like(up), np.uint64(1)
    out, at = np.zeros(len(a), dtype=bool), np.arange(len(a))
    for i in range(len(y)):
        if i % 16 == 0:
            on = (end > i) & (distance <= most)
            if on.sum() <= 0.8 * len(on):
                out[at] = distance <= most
                at, end, most, distance, corner, x, y, up, down = at[on], end[on], most[on], distance[on], corner[on], x[on], y[:, on], up[:, on], down[:, on]
                if not len(at):
                    return out
            if i == 0 or len(at) != len(nth):
                nth, word, bit = np.arange(len(at)), corner // 64, (corner % 64).astype(np.uint64)
                window = np.empty((len(at), wide), dtype=bool)
        np.equal(x[:, i : i + wide], y[i][:, None], out=window)
        same = np.packbits(window.reshape(-1), bitorder="little").view(np.uint64).reshape(-1, words).T
        added, carry = same & up, None
        for k in range(words):
            total = added[k] + up[k]
            over = total < up[k]
            if carry is not None:
                total += carry
                over |= total < carry
            added[k], carry = total, over.astype(np.uint64)
        flat = (added ^ up) | same | down
        distance += ((flat[word, nth] >> bit & one) == 0) & (end > i)
        rise, fall = down | ~(flat | up), flat & up
        after = flat >> one
        after[:-1] |= flat[1:] << np.uint64(63)
        up, down = fall | ~(after | rise), after & rise
    out[at] = distance <= most
    return out


def _lines(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Ids, line numbers and normalised lines of ``least`` bytes or more."""
    for rows, texts in steps(batches, "text", _STEP):
        found: tuple[list, list[int], list[bytes]] = ([], [], [])
        for doc, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
            for i, line in enumerate(text.split(b"\n")):
                if len(line) >= least and len(x := normalised(line)) >= least:
                    found[0].append(doc), found[1].append(i), found[2].append(x)
        if found[0]:
            yield found


def _ids(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of 128-bit hashes."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), dtype=">i8").astype(np.int64)
    return both[::2], both[1::2]


def across_components(placed: DataFrame, lines: DataFrame, feasible: Callable[[Column, Column], Column], least: float | None = None) -> DataFrame:
    """Pairs (a, b) of (key, id, attr, component, hub) of keys with one hub in different components, by (id, line) of
    them and the hubs: all those of a similarity of ``least``; without it those that share a third of the smaller one's edits of the hub."""
    # keys of one hub share most of their lines, so each line is met under the hub once
    once = placed.groupBy("hub", "id").agg(F.first("attr").alias("attr"), F.first("component").alias("component")).join(lines, "id")
    if least is not None:
        return _by_blocks(once.drop("attr"), least)
    both = once.join(lines.select(F.col("id").alias("hub"), F.col("line").alias("hub_line")), "hub").select("hub", "id", "attr", "component", "line", "hub_line")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = []
            for x, hub in zip(rows.column("line").to_pylist(), rows.column("hub_line").to_pylist(), strict=True):
                own, other = ({t[i : i + _RUN] for i in range(max(len(t) - _RUN, 0) + 1)} for t in (x, hub))
                found.append([xxhash.xxh3_64_intdigest(r.encode()) - (1 << 63) for r in own - other])
            need = [-(-len(x) // 3) for x in found]
            columns = [*rows.drop_columns(["line", "hub_line"]).columns, pa.array(found, pa.list_(pa.int64())), pa.array(need, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names[:-2], "edits", "need"])

    held = saved(both.mapInArrow(run, f"hub long, id long, attr {_ATTR}, component long, edits array<long>, need int"))
    edits = held.select("hub", "id", "attr", "component", "need", F.explode("edits").alias("edit"))
    x, y = edits.alias("x"), edits.alias("y")
    met = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.edit") == F.col("y.edit")) & (F.col("x.component") < F.col("y.component")) & feasible(F.col("x.attr"), F.col("y.attr")))
    shared = met.groupBy("x.hub", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.least("x.need", "y.need").alias("need")).count()
    return shared.where(F.col("count") >= F.col("need")).select("a", "b").distinct()


def _by_blocks(held: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of (hub, id, component, line) with one hub, in different components, of a similarity of ``least``.

    Lines that are in their hub's largest component already meet only those that aren't. A hub's lines are dealt
    into blocks of about ``_BLOCK``, and each two blocks, one of lines of the other components and one of all, are a group: no
    row is made for a pair that isn't similar, and no group outgrows a task, however many lines the hub has."""
    sizes = held.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
    hubs = sizes.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("core"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    blocks = F.ceil(F.greatest(F.col("n") / _BLOCK, F.col("chars") / _BLOCK_CHARS))
    hubs = saved(hubs.select("hub", F.col("core.component").alias("core"), blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil((1 - F.col("core.n") / F.col("n")) * blocks)).alias("rests")))
    spread = F.xxhash64("id")
    dealt = held.join(small_side(hubs), "hub").select("hub", "id", "component", "line", (F.col("component") != F.col("core")).alias("rest"), "blocks", "rests", spread.alias("spread"))
    all_, rest = F.pmod("spread", "blocks"), F.pmod(F.shiftright("spread", 20), F.col("rests"))
    own = ["id", "component", "line", "rest"]
    first = dealt.where("rest").select("hub", rest.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), F.lit(True).alias("first"), *own)
    second = dealt.select("hub", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("x"), all_.alias("y"), F.lit(False).alias("first"), *own)

    def run(rows: pa.Table) -> pa.Table:
        sides = [rows.filter(m) for m in (rows.column("first"), pc.invert(rows.column("first")))]
        (i, c, n, _), (j, d, m, rest) = ((t.column("id").to_numpy(), t.column("component").to_numpy(), pc.utf8_length(t.column("line")).to_numpy(), t.column("rest").to_numpy()) for t in sides)
        # of two lines that both are of the rest each is on both sides
        meet = (c[:, None] != d) & (~rest | (i[:, None] < j)) & (np.minimum(n[:, None], m) >= least * np.maximum(n[:, None], m) - 1e-9)
        x, y = np.nonzero(meet)
        first, second = (t.column("line").to_pylist() for t in sides)
        good = [np.zeros(0, dtype=bool)]
        for at in range(0, len(x), _PAIRS):
            good.append(similar_all([first[k] for k in x[at : at + _PAIRS]], [second[k] for k in y[at : at + _PAIRS]], least))
        good = np.concatenate(good)
        a, b = i[x[good]], j[y[good]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return first.union(second).groupBy("hub", "x", "y").applyInArrow(run, "a long, b long").distinct()


def removed_lines(docs: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """(doc_id, removed), saved: for the ids of (doc_id, text) that lose lines, the lines' numbers."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, at, lines in _lines(batches, 1):
            first: dict[bytes, int] = {}
            for i, x in enumerate(lines):
                first.setdefault(x, i)
            ids, checks = _ids(lines)
            sims, keys, ends, size = _keyed(list(first), similarity)
            # what a line's first place in the step has, the others lack
            at_first = np.array(list(first.values()))
            again = np.ones(len(lines), dtype=bool)
            again[at_first] = False
            n, sim, count = (np.zeros(len(lines), dtype=np.int64) for _ in range(3))
            n[at_first], sim[at_first], count[at_first] = size, sims, np.diff(ends, prepend=0)
            attr = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(sim)], names=["n", "sim"], mask=pa.array(again))
            offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.array(keys), mask=pa.array(again))
            columns = [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(ids), pa.array(checks), attr, found]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "id", "check", "attr", "keys"])

    read = saved(docs.mapInArrow(hashed, f"doc_id long, line int, id long, check long, attr {_ATTR}, keys array<long>"))
    seen = read.select("doc_id", "line", "id", "check")

    def could(lo: Column, hi: Column, few: Column, apart: Column) -> Column:
        return (lo >= similarity * hi - 1e-9) & (few | (F.bit_count(apart) <= BITS))

    def near(x: Column, y: Column) -> Column:
        return could(F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"]), (x["sim"] == 0) | (y["sim"] == 0), x["sim"].bitwiseXOR(y["sim"]))

    n, sim = F.col("attr.n"), F.col("attr.sim")
    pair = could(F.min(n), F.max(n), F.bool_or(sim == 0), F.bit_xor(sim))
    # a line that is read in several steps has its keys several times, so keys count by the lines that they differ in
    keys = read.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    keys = saved(keys.where("lo != hi").select("key"))
    several = id_bitmap(keys.select(F.col("key").alias("id")))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found, attr = rows.column("keys"), rows.column("attr")
            key = found.flatten().to_numpy()
            on = np.flatnonzero(in_bitmap(several.value, key))
            row = np.repeat(np.arange(len(rows)), found.value_lengths().to_numpy())[on]
            columns = [pa.array(key[on]), *(x.take(pa.array(row)) for x in (rows.column("id"), attr.field("n"), attr.field("sim")))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "sim"])

    held = read.where("size(keys) > 0").select("id", "attr", "keys").mapInArrow(keyed, "key long, id long, n int, sim long")
    held = saved(held.join(keys, "key", "left_semi").distinct())
    members = shared_only(held.select("key", "id", F.struct("n", "sim").alias("attr")), None, pair)

    wanted = saved(members.select("id").distinct())
    bitmap = id_bitmap(wanted)

    def spelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, lines in _lines(batches, 1):
            lines = list(dict.fromkeys(lines))
            ids, _ = _ids(lines)
            at = np.flatnonzero(in_bitmap(bitmap.value, ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([lines[i].decode() for i in at], pa.string())], names=["id", "line"])

    text = saved(docs.mapInArrow(spelled, "id long, line string").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b").select("a", "b", "x", "y")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                good = similar_all(rows.column("x").to_pylist(), rows.column("y").to_pylist(), similarity)
                yield rows.select(["a", "b"]).filter(pa.array(good))

        return both.mapInArrow(run, "a long, b long")

    linked = link(members, near, verified, lambda placed: across_components(placed, text, near, similarity), SMALL)
    # a line that is linked with no other is named by all 128 bits, so that no unequal lines share a name
    nodes = seen.groupBy("id", "check").agg(F.count("*").alias("n")).join(small_side(linked), "id", "left").where("n > 1 or component is not null")
    named = saved(nodes.select("id", "check", F.coalesce("component", "id").alias("group"), F.when(F.col("component").isNull(), F.col("check")).alias("rest")))
    places = saved(seen.join(small_side(named), ["id", "check"]).select("doc_id", "line", "group", "rest"))
    at = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line")).alias("first")
    firsts = saved(places.groupBy("group", F.col("rest").alias("other")).agg(at))
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line") == F.col("first.line")))
    later = places.join(small_side(firsts), "group").where(F.col("rest").eqNullSafe(F.col("other")) & again)
    gone = saved(later.groupBy("doc_id").agg(F.collect_set("line").alias("removed")))
    discard(read, keys, held, members, wanted, text, linked, named, places, firsts)
    return gone


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """``docs`` with the lines removed that repeat, or nearly, an earlier one anywhere:
    the text without them, and ``_n_lines``, ``_n_removed`` (long), which replace columns
    of these names; any others pass through.

    Of a group of linked lines the first occurrence by doc_id, then line, stays. Lines
    end at ``\\n``; empty ones stay. A null text stays null and
    has no lines; an empty one has one. Rows that share an id are one document: a line
    at the same place of both counts once. A null id comes after all others.
    """
    docs = docs.drop("_n_lines", "_n_removed")
    other, gone_name = added_names(docs, "id", "removed")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # by shuffle at every size: lists unpack to many times their files, on which the planner would judge
    gone = removed_lines(own, similarity).select(F.col("doc_id").alias(other), F.col("removed").alias(gone_name)).hint("merge")
    joined = docs.join(gone, docs[doc_id].cast("long").eqNullSafe(gone[other]), "left").select(*[docs[c] for c in docs.columns], gone_name)
    shape = docs.withColumns({"_n_lines": F.lit(0).cast("long"), "_n_removed": F.lit(0).cast("long")}).schema
    at = docs.columns.index(text)

    def rebuilt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in steps(batches, text):
            removed, valid = rows.column(gone_name).to_pylist(), rows.column(at).is_valid().to_pylist()
            out, n, less = [], [], []
            for x, gone_, there in zip(texts, removed, valid, strict=True):
                lines, gone_ = x.split(b"\n") if there else [], set(gone_ or ())
                kept = [line for i, line in enumerate(lines) if i not in gone_]
                out.append(b"\n".join(kept).decode() if there else None), n.append(len(lines)), less.append(len(lines) - len(kept))
            columns = list(rows.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(less, pa.int64())], names=shape.names)

    return joined.mapInArrow(rebuilt, shape)
