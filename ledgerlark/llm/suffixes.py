"""Operator 3: removal of long repeated byte strings by difference-cover suffix sorting.

Where a string of `length` bytes starts more than once, every byte it covers goes. Finding all such
starts takes two steps.

Routing. Each window of `length` bytes is owned by an anchor in it: the leftmost 64-byte string with
the least hash. Equal windows have equal anchors at equal offsets, so they can only meet under one
anchor hash, and the windows that one anchor owns follow one another: one stretch of text, a context.
Anchors that occur once (nearly all) end here, with some twenty bytes each. Contexts that occur again
as a whole are repeats throughout; these two cases need no text.

Sorting. Contexts under one anchor that are not all equal are cut from the texts and dealt out by
anchor. A task joins them into one string and sorts its suffixes by the difference cover modulo 3:
sampled triples are sorted and named, names are sorted recursively, the remaining suffixes are merged
in, and adjacent suffixes are compared over `length` bytes.

An anchor with more different contexts than a task should sort is settled by counting 128-bit hashes
of blocks of its windows, halved where they differ: aggregations that combine map-side and have no hot
task.

Passages. Beside the bytes, words that lie in a run of more than fifty words which another document has
as well are counted: such a passage may be shorter than `length` bytes. Runs of words are routed in the
same way, by anchors of eight words; the windows of contexts that are not equal as a whole are told
apart by 128-bit hashes. This removes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import make, pieces
from .scratch import Scratch

LENGTH = 400
ANCHOR = 64
#: Windows of very long documents are looked at in stretches of this many.
STRETCH = 1 << 20
#: Text sorted at once in a task.
SORT_BYTES = 1 << 20
#: Different contexts of one anchor beyond which blocks of windows are counted by hash.
HOT_CONTEXTS = 256
FIRST_BLOCK = 64
#: A passage is a run of so many words or more that another document has too; its anchors are so many words long.
PASSAGE_WORDS, ANCHOR_WORDS = 51, 8
_MIN = -(1 << 63)

_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 63, 32, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def window_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every `length` symbols (each a random number), by doubling."""
    if len(symbols) < length:
        return np.empty(0, np.uint64)
    now, size, out, done, k = symbols, 1, None, 0, 0
    rest = length
    while True:
        if rest & 1:
            if out is None:
                out, done = now, size
            else:
                m = len(symbols) - done - size + 1
                out = out[:m] * _MULTIPLY[k] ^ now[done : done + m]
                out ^= out >> np.uint64(29)
                out *= _MULTIPLY[31 - k]
                done += size
        rest >>= 1
        if not rest:
            return out[: len(symbols) - length + 1]
        m = len(now) - size
        now = now[:m] * _MULTIPLY[k] + now[size : size + m]
        now ^= now >> np.uint64(32)
        size, k = 2 * size, k + 1


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size, now = 1, a
    while 2 * size <= width:
        now = np.minimum(now[: len(now) - size], now[size:])
        size *= 2
    extra = width - size
    return np.minimum(now[: len(now) - extra], now[extra:]) if extra else now


def byte_symbols(data: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(data, np.uint8)]


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2^64, kept between calls."""
    if len(_POWERS[0]) < n:
        steps = np.full(n, _MULTIPLY[3], np.uint64)
        steps[0] = 1
        _POWERS[0] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0]


class Words:
    """The words ([^\\x20\\x09-\\x0D]+) of several texts in one sequence: symbols (a hash of each), and of text k the words bounds[k] to bounds[k + 1]; start and end are bytes of its text."""

    def __init__(self, texts: list[bytes]):
        codes = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = np.concatenate(([False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sizes = end - start
        first = np.cumsum(sizes) - sizes
        if len(sizes):
            within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            h = np.add.reduceat(_BYTE[codes[inside[1:-1]]] * _powers(int(sizes.max()))[within], first) + sizes.astype(np.uint64)
        else:
            h = np.empty(0, np.uint64)
        h ^= h >> np.uint64(32)
        h *= _MULTIPLY[5]
        self.symbols = h ^ h >> np.uint64(29)
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(start, offset)
        base = np.repeat(offset[:-1], np.diff(self.bounds))
        self.start, self.end = start - base, end - base

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of the sequence its text, and whether it lies in one text."""
        at = np.arange(max(len(self.symbols) - length + 1, 0))
        text = np.searchsorted(self.bounds, at, "right") - 1
        return text, at + length <= self.bounds[text + 1]


def word_contexts(words: Words, length: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, number of windows) of the contexts of all texts, as arrays; see `contexts`."""
    text, whole = words.windows(length)
    width = length - anchor + 1
    for lo in range(0, len(text), STRETCH):
        hi = min(lo + STRETCH, len(text))
        names = window_hashes(words.symbols[lo : hi + length - 1], anchor)
        keyed = (names >> np.uint64(22) << np.uint64(22)) | np.arange(len(names), dtype=np.uint64)
        owner = (_sliding_min(keyed, width) & np.uint64((1 << 22) - 1)).astype(np.int64)
        new = (np.diff(owner) != 0) | (np.diff(text[lo:hi]) != 0) | (np.diff(whole[lo:hi].astype(np.int8)) != 0)
        first = np.concatenate(([0], np.flatnonzero(new) + 1))
        n = np.diff(np.concatenate((first, [hi - lo])))
        keep = whole[lo + first]
        yield names[owner[first]].view(np.int64)[keep], (first + lo)[keep], n[keep]


def contexts(whole: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first window, number of windows, first window less anchor) of each context; together they own every window once."""
    windows, width = len(whole) - length + 1, length - anchor + 1
    for lo in range(0, max(windows, 0), STRETCH):
        hi = min(lo + STRETCH, windows)
        names = window_hashes(whole[lo : hi + length - 1], anchor)
        bits = np.uint64(22)  # positions of a stretch fit: STRETCH + length < 2^22
        keyed = (names >> bits << bits) | np.arange(len(names), dtype=np.uint64)
        owner = (_sliding_min(keyed, width) & np.uint64((1 << 22) - 1)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        first = np.concatenate(([0], cuts))
        n = np.diff(np.concatenate((first, [len(owner)])))
        at = names[owner[first]].view(np.int64)
        yield from zip(at.tolist(), (first + lo).tolist(), n.tolist(), (first - owner[first]).tolist(), strict=True)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (numbers from 1) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    if int(s.max()) >= 1 << 20:  # keep three of them in 63 bits
        s[:n] = np.unique(s[:n], return_inverse=True)[1] + 1
    # sort the sampled triples and name them; the extra sample at n ends the first half where n = 1 modulo 3
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    packed = s[sample] << 42 | s[np.minimum(sample + 1, n + 2)] << 21 | s[np.minimum(sample + 2, n + 2)]
    distinct, names = np.unique(packed, return_inverse=True)
    if len(distinct) == len(sample):
        order = sample[np.argsort(names)]
    else:  # recurse on the names
        order = sample[suffix_array(names + 1)]
    rank = np.zeros(n + 4, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    # the remaining suffixes: first number, then the rank of the sampled suffix after it
    rest = np.arange(0, n, 3)
    wide = n + 4
    rest = rest[np.argsort(s[rest] * wide + rank[rest + 1], kind="stable")]
    # merge: a remaining suffix compares with samples of either residue by one or two numbers and a rank
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(s[ones] * wide + rank[ones + 1], s[rest] * wide + rank[rest + 1])
    pair = lambda i: (s[i] << 21 | s[i + 1]) * wide + rank[i + 2]
    if int(s.max()) << 21 < (1 << 62) // wide:
        before += np.searchsorted(pair(twos), pair(rest))
    else:
        both = np.unique(np.concatenate((s[twos] << 21 | s[twos + 1], s[rest] << 21 | s[rest + 1])), return_inverse=True)[1]
        before += np.searchsorted(both[: len(twos)] * wide + rank[twos + 2], both[len(twos) :] * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = order
    return out


def repeated_starts(parts: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its first `windows` starts begin a string of `length` bytes that begins at another start of any part too."""
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    joined = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    symbols = joined.astype(np.int64) + 2
    symbols[begin + sizes] = 1  # between parts
    order = suffix_array(symbols)
    owned = np.zeros(len(joined), bool)
    for b, w in zip(begin.tolist(), windows, strict=True):
        owned[b : b + w] = True
    order = order[owned[order]]
    view = np.lib.stride_tricks.sliding_window_view(joined, length) if len(joined) >= length else joined[:0].reshape(0, length)
    same = np.zeros(max(len(order) - 1, 0), bool)
    left, right = order[:-1], order[1:]
    may = np.flatnonzero((joined[left] == joined[right]) & (joined[left + length // 2] == joined[right + length // 2]) & (joined[left + length - 1] == joined[right + length - 1]))
    for lo in range(0, len(may), 8192):  # adjacent prefixes, compared byte by byte
        at = may[lo : lo + 8192]
        same[at] = (view[left[at]] == view[right[at]]).all(1)
    again = np.zeros(len(joined), bool)
    again[left[same]] = True
    again[right[same]] = True
    return [again[b : b + w] for b, w in zip(begin.tolist(), windows, strict=True)]


def _stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First index and number of each run of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first.tolist(), (np.flatnonzero(edge == -1) - first).tolist()


def _document(key: Column, text: Column) -> list[Column]:
    """A text is known by its key and its hash; a null key is a value like any other."""
    return [F.coalesce(key.cast("bigint"), F.lit(_MIN)).alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")]


def repeated_windows(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT_CONTEXTS, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(d, t, s, w): w windows from byte s on start elsewhere too; and `others` (d, t, a, b, ...) with the bytes x from a to b.

    One join with the texts serves both.
    """
    long_ = docs.select(*_document(F.col(key), F.col(text)), F.col(text).alias("text")).where(F.octet_length("text") >= length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("name", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("s", pa.int32()), ("w", pa.int32()), ("o", pa.int32())])
        for batch in pieces(batches, "text", 2 << 20):
            d, t, rows, digests = [], [], [], []
            for dd, tt, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = x.encode()
                own = list(contexts(byte_symbols(data), length))
                rows += own
                digests += [hashlib.md5(data[s : s + w + length - 1]).digest() for _, s, w, _ in own]
                d += [dd] * len(own)
                t += [tt] * len(own)
            if rows:
                c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield make(schema, d, t, [r[0] for r in rows], np.ascontiguousarray(c[:, 0]), np.ascontiguousarray(c[:, 1]), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])

    found = scratch.write(long_.mapInArrow(anchors, "d bigint, t bigint, name bigint, c1 bigint, c2 bigint, s int, w int, o int"))
    # a context occurs n times; z is any one of its places
    groups = scratch.write(found.groupBy("name", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "t", "s", "w", "o")).alias("z")))
    mixed = scratch.write(groups.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    wholly = scratch.write(groups.where("n > 1").select("c1", "c2"))
    whole = found.join(wholly, ["c1", "c2"]).select("d", "t", "s", "w")
    open_ = scratch.write(groups.join(mixed, "name").select("name", "k", "n", "z.*"))
    scratch.drop(groups)
    # the contexts' text; a join with the texts moves them once
    wanted = open_.withColumns({"a": F.col("s"), "b": F.col("s") + F.col("w") + length - 1})
    every = wanted if others is None else wanted.unionByName(others.withColumn("other", F.lit(True)), allowMissingColumns=True)
    texts = docs.select(*_document(F.col(key), F.col(text)), F.col(text).alias("text")).where(F.octet_length("text") >= (length if others is None else 2 * PASSAGE_WORDS - 1))
    every = scratch.write(every.join(texts, ["d", "t"]).select(*every.columns, F.substring(F.col("text").cast("binary"), F.col("a") + 1, F.col("b") - F.col("a")).alias("x")))
    scratch.drop(open_)
    cut = every.select("name", "k", "n", "d", "t", "s", "w", "o", "x") if others is None else every.where("other is null").select("name", "k", "n", "d", "t", "s", "w", "o", "x")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("w", pa.int32())])

        def settle(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_starts([r[5] for r in rows], [r[4] for r in rows], length)
            out = [(r[1], r[2], r[3] + a, n) for r, f in zip(rows, flags, strict=True) if f.any() for a, n in zip(*_stretches(f), strict=True)]
            return make(schema, *([list(c) for c in zip(*out, strict=True)] if out else [[]] * 4))

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "d", "t", "s", "w", "x")), strict=True):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                if held and held[-1][:4] == row[:4]:
                    continue  # a repeated row of the table; its contexts are repeats as a whole
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)

    sorted_ = cut.where(F.col("k") <= hot).select("name", "d", "t", "s", "w", "x").repartition("name").sortWithinPartitions("name", "d", "t", "s")
    partly = sorted_.mapInArrow(sort, "d bigint, t bigint, s int, w int")
    out = whole.unionByName(partly)

    if not mixed.where(F.col("k") > hot).isEmpty():
        out = out.unionByName(_halved(cut.where(F.col("k") > hot).dropDuplicates(["d", "t", "s"]), scratch, length))
    return out, None if others is None else every.where("other").select(*others.columns, "x")


def _halved(cut: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """repeated_windows for contexts (d, t, s, w, o, x) of which many share an anchor, without sorting them together.

    Windows are taken in blocks of neighbouring offsets from the anchor. All windows of a block hold
    its core; so a core that occurs once settles the block: none is a repeat. The stretch that the
    block's windows cover settles it too if it occurs again: all are. What is left is halved, down to
    single windows, whose core and stretch are the window itself. Occurrences are counted by 128-bit
    hash with a map-side combined aggregation, so an anchor may have any number of contexts, and only
    blocks at the edge of a shared passage are halved on.
    """
    size = FIRST_BLOCK
    first = F.floor(F.col("o") / size).cast("int")
    last = F.floor((F.col("o") + F.col("w") - 1) / size).cast("int")
    todo = cut.select("d", "t", "s", F.explode(F.sequence(first, last)).alias("b")).select("d", "t", "s", (F.col("b") * size).alias("lo"))
    out = None
    while size:

        def hashed(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("w", pa.int32()), ("o", pa.int32()), ("lo", pa.int32()), *((k, pa.int64()) for k in ("c1", "c2", "e1", "e2"))])
            none = [None, None]
            for batch in batches:
                cores, covers = [], []
                for o, lo, x in zip(*(batch.column(c).to_pylist() for c in ("o", "lo", "x")), strict=True):
                    mark, a = lo.to_bytes(4, "little", signed=True), lo - o
                    cores.append(np.frombuffer(hashlib.md5(mark + x[a + size - 1 : a + length]).digest(), np.int64).tolist())
                    inside = a >= 0 and a + size - 1 + length <= len(x)
                    covers.append(np.frombuffer(hashlib.md5(mark + x[a : a + size - 1 + length]).digest(), np.int64).tolist() if inside else none)
                yield make(schema, *(batch.column(c) for c in ("d", "t", "s", "w", "o", "lo")), *map(list, zip(*cores, strict=True)), *map(list, zip(*covers, strict=True)))

        blocks = todo.join(cut, ["d", "t", "s"]).select("d", "t", "s", "w", "o", "lo", "x")
        blocks = scratch.write(blocks.mapInArrow(hashed, "d bigint, t bigint, s int, w int, o int, lo int, c1 bigint, c2 bigint, e1 bigint, e2 bigint"))
        at = F.struct("d", "t", "s")
        again = lambda df, a, b: scratch.write(df.where(F.col(a).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias(f"{a}_first")).where("n > 1").drop("n"))  # noqa: B023, E731
        whole = blocks.join(again(blocks, "e1", "e2"), ["e1", "e2"], "left")
        start, end = F.greatest(F.col("lo"), F.col("o")), F.least(F.col("lo") + size, F.col("o") + F.col("w"))
        full = whole.where("e1_first is not null").select("d", "t", (F.col("s") - F.col("o") + start).alias("s"), (end - start).alias("w"))
        out = full if out is None else out.unionByName(full)
        if size == 1:
            break
        # of equal stretches one goes on: a context that owns only a part of the block may still meet it
        left = whole.where(F.col("e1_first").isNull() | (F.col("e1_first") == at)).join(again(blocks, "c1", "c2"), ["c1", "c2"])
        half = size // 2
        todo = left.select("d", "t", "s", "w", "o", F.explode(F.array(F.col("lo"), F.col("lo") + half)).alias("lo"))
        todo = scratch.write(todo.where((F.col("lo") + half > F.col("o")) & (F.col("lo") < F.col("o") + F.col("w"))).select("d", "t", "s", "lo"))
        if todo.isEmpty():
            break
        size = half
    return out


def shared_contexts(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts of words whose anchors are in several documents (d, t, c1, c2, s, w, ..); those that are shared as a whole (c1, c2, runs); and, of anchors with several contexts, one place each (c1, c2, lo, hi, d, t, a, b)."""
    texts = docs.select(*_document(F.col(key), F.col(text)), F.col(text).alias("text")).where(F.octet_length("text") >= 2 * words - 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("name", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("s", pa.int32()), ("w", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
        for batch in pieces(batches, "text", 2 << 20):
            own = Words([x.encode() for x in batch.column("text").to_pylist()])
            raw = own.symbols.tobytes()
            for name, first, n in word_contexts(own, words, ANCHOR_WORDS):
                if not len(name):
                    continue
                last = first + n + words - 2
                c = np.frombuffer(b"".join([hashlib.md5(raw[i:j]).digest() for i, j in zip((8 * first).tolist(), (8 * last + 8).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                k = np.searchsorted(own.bounds, first, "right") - 1
                d, t = (batch.column(x).to_numpy()[k] for x in ("d", "t"))
                yield make(schema, d, t, name, np.ascontiguousarray(c[:, 0]), np.ascontiguousarray(c[:, 1]), (first - own.bounds[k]).astype(np.int32), n.astype(np.int32), own.start[first].astype(np.int32), own.end[last].astype(np.int32))

    found = scratch.write(texts.mapInArrow(anchors, "d bigint, t bigint, name bigint, c1 bigint, c2 bigint, s int, w int, a int, b int"))
    who = F.xxhash64("d", "t")
    # anchors in one document only end here: nearly all
    names = scratch.write(found.groupBy("name").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("name"))
    held = scratch.write(found.join(names, "name"))
    scratch.drop(found, names)
    # a context is in the documents lo to hi; contexts in several are shared as a whole
    groups = scratch.write(held.groupBy("name", "c1", "c2").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.min(F.struct("d", "t", "s", "w", "a", "b")).alias("z")))
    mixed = groups.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("name")
    open_ = scratch.write(groups.join(mixed, "name").select("c1", "c2", "lo", "hi", "z.d", "z.t", "z.a", "z.b"))
    wholly = scratch.write(groups.where("lo <> hi").select("c1", "c2", F.array(F.struct(F.lit(0).alias("i"), F.col("z.w").alias("n"))).alias("runs")))
    scratch.drop(groups)
    return held, wholly, open_


def told_apart(held: DataFrame, wholly: DataFrame, cut: DataFrame, scratch: Scratch, words: int = PASSAGE_WORDS) -> DataFrame:
    """(d, t, s, w): w windows of `words` words, from the s-th word on, that another document has too.

    held, wholly: see `shared_contexts`; cut: the open contexts with their bytes x.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("i", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
        for batch in pieces(batches, "x", 1 << 20):
            own = Words(batch.column("x").to_pylist())
            text, whole = own.windows(words)
            at = np.flatnonzero(whole)
            k = text[at]
            both = window_hashes(own.symbols, words), window_hashes(own.symbols[::-1], words)[::-1]
            yield make(schema, *(batch.column(c).to_numpy()[k] for c in ("c1", "c2", "lo", "hi")), (at - own.bounds[k]).astype(np.int32), *(h[at].view(np.int64) for h in both))

    each = scratch.write(cut.mapInArrow(windows, "c1 bigint, c2 bigint, lo bigint, hi bigint, i int, h1 bigint, h2 bigint"))
    again = scratch.write(each.groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h1", "h2"))
    partly = each.where("lo = hi").join(again, ["h1", "h2"]).groupBy("c1", "c2").agg(F.transform(F.collect_list("i"), lambda i: F.struct(i.alias("i"), F.lit(1).alias("n"))).alias("runs"))
    shared = scratch.write(wholly.unionByName(partly))
    scratch.drop(each, again)
    return held.join(shared, ["c1", "c2"]).select("d", "t", F.explode(F.transform("runs", lambda r: F.struct((F.col("s") + r["i"]).alias("s"), r["n"].alias("w")))).alias("r")).select("d", "t", "r.*")


def _merged(runs: list | None, length: int) -> list[list[int]]:
    """The intervals that windows of `length`, w from s on, cover; joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted((r["s"], r["s"] + r["w"] - 1 + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, words: int = PASSAGE_WORDS) -> DataFrame:
    """Each document without its repeated bytes: key, n_bytes, n_removed, spans, kept (binary), passages.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    document too (overlaps count); strings are judged on the input. spans: [start, end) of the maximal
    removed runs. passages: [start, end) of the words, counted from 0, that lie in a run of `words`
    words which another document has too, whatever is between the words; nothing is removed for them.
    Null texts are empty; texts shorter than `length` stay whole; repeated rows are repeats of one
    another, but no other document; every row gives one row; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    listed = lambda df, name: df.groupBy("d", "t").agg(F.collect_list(F.struct("s", "w")).alias(name))
    held, wholly, open_ = shared_contexts(docs, scratch, key, text, words)
    windows, cut_ = repeated_windows(docs, scratch, key, text, length, HOT_CONTEXTS, open_)
    runs = scratch.write(listed(windows, "runs"))
    passages = listed(told_apart(held, wholly, cut_, scratch, words), "passages")
    runs = scratch.write(runs.join(passages, ["d", "t"], "full"))
    scratch.keep(runs)
    d, t = _document(F.col(key), F.col(text))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), d.alias("d"), t.alias("t"))
    joined = rows.join(runs, ["d", "t"], "left").select("_key", "_text", "runs", "passages")
    kind = joined.schema["_key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.list_(pa.int64()))
        for batch in pieces(batches, "_text"):
            schema = pa.schema([batch.schema.field("_key"), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", spans_of), ("kept", pa.binary()), ("passages", spans_of)])
            n, removed, spans, kept = [], [], [], []
            for x, own in zip(batch.column("_text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data, merged = x.encode(), _merged(own, length)
                at = [0, *(e for s in merged for e in s), len(data)]
                n.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                spans.append(merged)
                kept.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
            yield make(schema, batch.column("_key"), n, removed, spans, kept, [_merged(r, words) for r in batch.column("passages").to_pylist()])

    out = joined.mapInArrow(cut, f"_key {kind}, n_bytes bigint, n_removed bigint, spans array<array<bigint>>, kept binary, passages array<array<bigint>>")
    return out.withColumnRenamed("_key", key)


def query(docs: DataFrame) -> DataFrame:
    out = drop_repeats(docs)
    in_passages = F.aggregate("passages", F.lit(0).cast("bigint"), lambda n, p: n + p[1] - p[0])
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), in_passages.alias("n_passage_words"))
