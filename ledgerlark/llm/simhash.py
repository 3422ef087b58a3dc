"""Operator 2: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with exclusive-or and bit counts in numpy. A
tile holds fingerprints with the same population counts in fixed segments of the fingerprint; where
the counts of two tiles differ by more than the radius in sum, no pair of them can be within it,
and the pair of tiles is skipped. (The sum over segments is at least the difference of the whole
population counts, so this skips all that the plain rule skips, and more.) With a wide radius the
counts alone skip little, and shingle counts, which similar texts cannot differ in much, choose the
tiles instead; population counts then skip within them.

Equal fingerprints are one row throughout. A tile pair hands on a spanning forest of its links, not
the links, so a group of copies costs as many rows as it has members.

With a least similarity, fingerprints only propose: what they link is compared again within its
component, shingle set against shingle set, and only pairs that are similar enough are linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import make, pieces
from .components import components
from .scratch import Scratch

SEEDS = (42, 0x9E3779B97F4A7C15)
TILE_ROWS = 32768
SEGMENTS = 4
#: Pairs whose first words differ in more than this share of the radius are not compared further. A word has half of a fingerprint's
#: bits, so of pairs at the radius itself nearly all are kept, and of unrelated ones few.
FIRST_SHARE = 0.67
#: Pairs of fingerprints that are compared in one step: their difference stays in the processor's cache.
COMPARED_AT_ONCE = 1 << 16
#: Texts of fewer distinct shingles than SHORT differ in more bits at one similarity (ties of votes); where
#: the similarity is checked, WIDER bits are added to their radius.
SHORT, WIDER = 32, 8
#: Tiles whose shingle sets are compared are smaller: they hold the sets.
SET_TILE_ROWS, SET_TILE_SHINGLES = 2048, 1 << 20
#: Texts that may be similar are told by so many buckets of their keys before they are read again.
BUCKETS = 1 << 21


def shingles(text: str | None, size: int) -> list[bytes]:
    """Words ([^\\x20\\x09-\\x0D]+ after lower-casing A-Z) in runs of `size`, with repeats; fewer words: all of them as one; none: nothing."""
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []


def fingerprint(grams: list[bytes], seed: int = SEEDS[0]) -> int:
    """A bit is 1 where more than half of the shingles' XXH64 have it; no shingles: 0."""
    if not grams:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):
        ones += np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, words: int = 1, sets: bool = False, grams: bool = False) -> DataFrame:
    """_key, f0 (, f1) signed 64-bit, n shingles: one row per row.

    sets: repeats of a shingle do not count, and s is a hash of the set. grams: with the hashes of the distinct shingles.
    """
    more = [("s", pa.binary(), "binary")] * sets + [("grams", pa.list_(pa.int64()), "array<bigint>")] * grams
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            schema = pa.schema([batch.schema.field("_key"), *((f"f{k}", pa.int64()) for k in range(words)), ("n", pa.int64()), *((c, t) for c, t, _ in more)])
            rows = []
            for t in batch.column("_text").to_pylist():
                g, held = shingles(t, size), ()
                if sets:
                    g = list(set(g))
                    own = np.sort(np.fromiter((xxhash.xxh64_intdigest(x) for x in g), np.uint64)).view(np.int64)
                    held = (hashlib.md5(own.tobytes()).digest(), own)[: len(more)]
                rows.append((*(fingerprint(g, s) for s in SEEDS[:words]), len(g), *held))
            table = [np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in range(words)]
            yield make(schema, batch.column("_key"), *table, *([r[k] for r in rows] for k in range(words, words + 1 + len(more))))

    return source.mapInArrow(run, ", ".join([f"_key {kind}", *(f"f{k} bigint" for k in range(words)), "n bigint", *(f"{c} {t}" for c, _, t in more)]))


def segment_counts(f: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Population counts of the fingerprints' segments, as one number in base 65."""
    width, code = 64 // segments, np.zeros(len(f), np.int64)
    for s in range(segments):
        part = (f >> np.uint64(s * width)) & np.uint64((1 << width) - 1)
        code = code * 65 + np.bitwise_count(part).astype(np.int64)
    return code


def segment_steps(radius: int, segments: int = SEGMENTS) -> np.ndarray:
    """Differences of two tiles' codes that are not skipped: changes of the counts by `radius` at most in sum; each pair of tiles once."""
    steps = {(0,) * segments}
    for _ in range(radius):
        steps |= {tuple(x + d * (i == j) for j, x in enumerate(s)) for s in steps for i in range(segments) for d in (-1, 1)}
    weights = [65 ** (segments - 1 - i) for i in range(segments)]
    return np.array(sorted(v for s in steps if s >= (0,) * segments for v in [sum(a * b for a, b in zip(s, weights, strict=True))]), np.int64)


def near(a: np.ndarray, b: np.ndarray, radius: int, order_a: np.ndarray, order_b: np.ndarray, reach: Callable[[int, int], tuple[float, float]], first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (words x fingerprints) that differ in `radius` bits at most.

    Both are sorted, by order_a and order_b (population counts, or shingle counts): each stretch of a
    meets only the rows of b between the bounds that `reach` gives for the stretch's least and greatest.
    first: most bits that the first word may differ in; the others are compared only for pairs within it.
    """
    found_a, found_b = [], []
    step = max(1, COMPARED_AT_ONCE // max(1, b.shape[1]))
    for lo in range(0, a.shape[1], step):
        hi = min(lo + step, a.shape[1])
        least, most = reach(order_a[lo], order_a[hi - 1])
        start, stop = np.searchsorted(order_b, least, "left"), np.searchsorted(order_b, most, "right")
        if start >= stop:
            continue
        apart = np.bitwise_count(a[0, lo:hi, None] ^ b[0, None, start:stop])
        x, y = np.divmod(np.flatnonzero(apart <= min(radius, first or radius)), stop - start)
        if len(a) > 1 and len(x):
            total = apart[x, y].astype(np.int64)
            for k in range(1, len(a)):
                total += np.bitwise_count(a[k, lo + x] ^ b[k, start + y])
            x, y = x[total <= radius], y[total <= radius]
        found_a.append(x + lo)
        found_b.append(y + start)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, int), np.empty(0, int))


def forest(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (x, y): each node that has a smaller one with the smallest of its component."""
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        open_ = root[x] != root[y]
        if not open_.any():
            while (root[root] != root).any():
                root = root[root]
            open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    while (root[root] != root).any():
        root = root[root]
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def alike(grams: list[np.ndarray], x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (x, y) of sorted shingle sets are a forest of the pairs of that Jaccard similarity or more."""
    root, keep = list(range(len(grams))), np.zeros(len(x), bool)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(i), find(j)
        if a != b:
            both = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
            if both >= similarity * (len(grams[i]) + len(grams[j]) - both):
                keep[k], root[a] = True, b
    return keep


def links(prints: DataFrame, radius: int, scratch: Scratch, words: int = 1, by_length: float | None = None, tile_rows: int = TILE_ROWS, similarity: float | None = None, checked: bool = False) -> DataFrame:
    """A spanning forest, tile by tile, of the links among distinct fingerprints: (a, b) row ids.

    prints: id bigint, f0.., n. by_length: texts whose shingle counts have a smaller ratio than this
    are not compared, and lengths choose the tiles; else population counts do. similarity: of prints
    with `part` and `grams`, those of one part are linked whose shingle sets are so similar as well.
    checked: the links are, or will be, held to a similarity, and short texts have a wider radius.
    """
    fields = [f"f{k}" for k in range(words)]
    steps = segment_steps(radius) if by_length is None else np.array([0, 1])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), *((f, pa.int64()) for f in fields), ("n", pa.int64()), ("tile", pa.int64())])
        for batch in batches:
            f0, n = batch.column("f0").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            code = segment_counts(f0) if by_length is None else np.floor(np.log1p(n) / -np.log(by_length)).astype(np.int64)
            yield make(schema, batch.column("id"), *(batch.column(f) for f in fields), n, code)

    def whole_tiles() -> tuple[DataFrame, DataFrame, DataFrame]:
        home = prints.select("id", *fields, "n").mapInArrow(homes, "id bigint, " + "".join(f"{f} bigint, " for f in fields) + "n bigint, tile bigint")
        home = scratch.write(home)
        guest = home.withColumn("tile", F.explode(F.array(*[F.col("tile") + F.lit(int(s)) for s in steps])))
        # at most 17^4 population vectors, or some hundred lengths: the sizes of the tiles are bounded whatever the corpus
        sizes = home.groupBy("tile").agg(F.count(F.lit(1)).alias("h"))
        around = guest.groupBy("tile").agg(F.count(F.lit(1)).alias("g"))
        parts = lambda c: F.ceil(F.col(c) / tile_rows).cast("int")
        plan = F.broadcast(scratch.write(sizes.join(around, "tile").select("tile", parts("h").alias("hs"), parts("g").alias("gs"))))
        return home, guest, plan

    exact = similarity is not None
    extra = ["grams"] if exact else []
    if exact:
        width = F.floor(F.log1p("n") / F.lit(float(-np.log(by_length))))
        home = prints.select("id", *fields, "n", F.col("part"), width.alias("width"), *extra)
        home = scratch.write(home)
        guest = home.withColumn("width", F.explode(F.array(*[F.col("width") + F.lit(int(s)) for s in steps])))
        home, guest = (df.withColumn("tile", F.xxhash64("part", "width")) for df in (home, guest))
        weight = F.ceil(F.greatest(F.count(F.lit(1)) / SET_TILE_ROWS, F.sum("n") / SET_TILE_SHINGLES)).cast("int")
        # tiles of one part each are many; only those that are cut are sent to all tasks, and the rows bound their number
        cut = lambda df, c: df.groupBy("tile").agg(weight.alias(c)).where(F.col(c) > 1)
        plan = F.broadcast(scratch.write(cut(home, "hs").join(cut(guest, "gs"), "tile", "full")))
    else:
        home, guest, plan = whole_tiles()
    spread = lambda df, own, other, side: (
        df.join(plan, "tile", "left" if exact else "inner")
        .withColumns({c: F.coalesce(c, F.lit(1)) for c in ("hs", "gs")})
        .withColumn(own, F.pmod(F.xxhash64(*fields, "id", F.lit(side)), F.col(own + "s")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)))
        .select("tile", "h", "g", F.lit(side).alias("side"), "id", *fields, "n", *extra)
    )
    dealt = spread(home, "h", "g", 0).unionByName(spread(guest, "g", "h", 1))
    ordered = dealt.repartition("tile", "h", "g").sortWithinPartitions("tile", "h", "g", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        last = np.empty((5 + words, 0), np.int64)

        held: list[np.ndarray] = []

        def tile(rows: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
            cut = int(np.searchsorted(rows[3], 1))
            if not cut or cut == rows.shape[1]:
                return None
            ids, f = rows[4], rows[5 : 5 + words].view(np.uint64)
            wide = radius + WIDER if checked and rows[-1].min() < SHORT else radius
            if by_length is None:
                by, reach, first = np.bitwise_count(f).sum(0, dtype=np.int64), lambda least, most: (least - wide, most + wide), None
            else:  # each pair once: with the row that has more shingles, or as many, as the first
                by, reach, first = rows[-1], lambda least, most: (by_length * least, most), round(FIRST_SHARE * wide) if words > 1 else None
            low, high = np.argsort(by[:cut], kind="stable"), cut + np.argsort(by[cut:], kind="stable")
            x, y = near(f[:, low], f[:, high], wide, by[low], by[high], reach, first)
            x, y = low[x], high[y]
            keep = ids[x] != ids[y]
            if by_length is not None:
                n = rows[-1]
                keep &= np.minimum(n[x], n[y]) >= by_length * np.maximum(n[x], n[y])
            if exact:
                x, y = x[keep], y[keep]
                keep = alike(grams, x, y, similarity)
            if not keep.any():
                return None
            nodes, back = np.unique(np.concatenate((ids[x[keep]], ids[y[keep]])), return_inverse=True)
            return forest(nodes, back[: keep.sum()], back[keep.sum() :])

        def groups(rows: np.ndarray, whole: bool) -> Iterator[tuple[int, int]]:
            new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            cuts = [0, *new.tolist(), rows.shape[1]]
            yield from zip(cuts[: None if whole else -2], cuts[1 : None if whole else -1], strict=False)

        def results(rows: np.ndarray, held: list[np.ndarray], whole: bool) -> Iterator[pa.RecordBatch]:
            found = [r for a, b in groups(rows, whole) if (r := tile(rows[:, a:b], held[a:b])) is not None]
            if found:
                yield make(schema, np.concatenate([r[0] for r in found]), np.concatenate([r[1] for r in found]))

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tile", "h", "g", "side", "id", *fields, "n")])
            rows = np.concatenate((last, rows), axis=1) if last.shape[1] else rows
            if exact:
                lists = batch.column("grams")
                at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                held += [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            if not rows.shape[1]:
                continue
            yield from results(rows, held, False)
            end = np.flatnonzero((rows[:3] != rows[:3, -1:]).any(0))
            start = int(end[-1]) + 1 if len(end) else 0
            last, held = rows[:, start:], held[start:]
        if last.shape[1]:
            yield from results(last, held, True)

    return ordered.mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, radius: int = 2, words: int = 1, by_length: float | None = None, similarity: float | None = None) -> DataFrame:
    """Every row's fingerprint and component: key, f0.., component_id.

    component_id is the smallest key whose fingerprint is reachable over links of at most `radius`
    differing bits, itself included. Null and empty texts have fingerprint 0 and are linked like any
    other. Rows with a null key get the component of their fingerprint. Repeated rows repeat. Empty
    tables give no rows. Keys are integers.

    similarity (with by_length): links also need that Jaccard similarity of the sets of shingles, which
    is checked; equal sets are linked.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fields = [f"f{k}" for k in range(words)]
    exact = similarity is not None
    # a node is a fingerprint, or a set of shingles
    node = ["s"] if exact else fields
    prints = scratch.write(fingerprints(docs, key, text, size, words, exact))
    others = [F.min(f).alias(f) for f in fields if exact]
    distinct = scratch.write(prints.groupBy(*node).agg(F.min("_key").cast("bigint").alias("low"), F.min("n").alias("n"), *others))
    # nodes are named by their smallest key; those that only null keys have are linked to nothing
    named = distinct.select(F.col("low").alias("id"), *fields, "n", *(["s"] if exact else [])).where("id is not null")
    edges = links(named, radius, scratch, words, by_length, checked=exact)
    if exact:
        edges = scratch.write(edges)
        found = components(edges, scratch)
        parts = scratch.write(found.select(F.col("node").alias("id"), F.col("root").alias("part")).unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("part")).distinct()))
        chosen = scratch.write(named.join(parts, "id").select("id", "s", "part"))
        # texts are read again only where their key's bucket has a linked one; the buckets are few enough to be sent to all tasks
        bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(BUCKETS)).cast("int")
        buckets = F.broadcast(scratch.write(chosen.select(bucket("id").alias("_bucket")).distinct()))
        some = docs.select(key, text).where(F.col(key).isNotNull()).withColumn("_bucket", bucket(key)).join(buckets, "_bucket", "left_semi").select(key, text)
        sets = fingerprints(some, key, text, size, words, True, True).withColumn("id", F.col("_key").cast("bigint"))
        edges = links(sets.join(chosen, ["id", "s"]), radius, scratch, words, by_length, similarity=similarity, checked=True)
    found = components(edges, scratch)
    roots = scratch.write(
        distinct.join(found, F.col("low") == F.col("node"), "left").select(*node, F.coalesce("root", "low").alias("component_id"))
    )
    return prints.join(roots, node).select(F.col("_key").alias(key), *fields, "component_id")


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


