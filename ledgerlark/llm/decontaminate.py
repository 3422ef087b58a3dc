"""Operator 5: benchmark decontamination by Wu-Manber search over words.

The patterns are windows of ten words of the benchmark items (or the whole of a shorter item). The
text's symbols are words. A shift table over blocks of two words tells how far the search may jump;
where the shift is zero, the block's bucket lists the patterns that end so, and each is compared
word for word. A block that no pattern has allows the longest jump, so clean text is mostly skipped.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import carried, column, keyed, make, pieces
from .scratch import Scratch

WINDOW = 10
#: Benchmark text sent with the tasks at once; a larger benchmark is searched for in several rounds.
PATTERN_BYTES = 16 << 20
#: Bytes that are no part of a word ([^0-9a-z] in ASCII) become blanks; all others, so every part of a longer character, stay.
_BLANKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of 0-9, a-z and everything outside ASCII."""
    return (text or "").encode().lower().translate(_BLANKS).split()


class Search:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.length = m = len(next(iter(patterns)))
        self.block = block = min(2, m)
        self.far = m - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], list]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(block, m + 1):
                piece = pattern[end - block : end]
                self.shift[piece] = min(self.shift.get(piece, self.far), m - end)
            self.bucket[pattern[m - block :]].append((list(pattern), items))

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of each occurrence, from left to right."""
        m, far, shift, bucket, n = self.length, self.far, self.shift.get, self.bucket, len(text)
        i = m - 1
        two = self.block == 2
        while i < n:
            piece = (text[i - 1], text[i]) if two else (text[i],)
            jump = shift(piece, far)
            if jump:
                i += jump
                continue
            window = text[i - m + 1 : i + 1]
            for pattern, items in bucket[piece]:
                if pattern == window:
                    yield i - m + 1, items
            i += 1


def build(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Search]:
    by_length: dict[int, dict[tuple[bytes, ...], list]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            held = by_length[size][tuple(w[k : k + size])]
            if item not in held:
                held.append(item)
    return [Search(by_length[size]) for size in sorted(by_length)]


def search(text: str | None, tables: list[Search]) -> tuple[int, list[list[int]], list]:
    """Number of words, merged word intervals [start, end) that are hit, and the items found."""
    w = words(text)
    found, items = [], set()
    for table in tables:
        for start, own in table.occurrences(w):
            found.append((start, start + table.length))
            items.update(own)
    return len(w), _union(found), sorted(items - {None}, key=str)


def _union(spans: list[list[int]]) -> list[list[int]]:
    """Intervals joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


SPANS = pa.list_(pa.list_(pa.int64()))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", pattern_bytes: int = PATTERN_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Each document's occurrences of benchmark windows: key (or the columns named by carry, untouched, as a struct `row`), n_words, n_hit, spans, items, contaminated.

    spans: array of [start, end) word intervals that are hit; items: ids found, as strings, sorted.
    Items with a null id are searched for like any other: their hits count in spans, n_hit and
    contaminated, but they have no id to be listed in items.
    Null texts have no words; items without words are never found; repeated items are all found;
    repeated documents each give a row; empty tables give no rows, or no hits.

    The benchmark is collected in rounds of at most `pattern_bytes` (a single longer item is a round
    of its own). With one round the documents are not moved. With more, each round is sent, searched
    for, written and freed before the next; only texts that are hit hand on anything, by the digest of
    the text, and what the rounds found of one text is brought together.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = bench.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    rounds = max(1, -(-2 * total // pattern_bytes)) if total > pattern_bytes else 1
    source, where = keyed(docs, key, text, carry)
    kind = source.schema["_key"].dataType.simpleString()

    def sent(k: int):
        chosen = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == k) if rounds > 1 else bench
        return spark.sparkContext.broadcast([(r["i"], r["t"]) for r in chosen.toLocalIterator()])

    def found(texts: list, tables: list[Search]) -> tuple[list, list, list]:
        n, spans, own = [], [], []
        for t in texts:
            a, b, c = search(t, tables)
            n.append(a), spans.append([list(x) for x in b]), own.append(sorted(str(x) for x in c))
        return n, spans, own

    if rounds == 1:
        patterns = sent(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = build(patterns.value)
            for batch in pieces(batches, where):
                schema = pa.schema([batch.schema.field("_key"), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
                yield make(schema, batch.column("_key"), *found(column(batch, where).to_pylist(), tables))

        made = source.mapInArrow(run, f"_key {kind}, n_words bigint, spans array<array<bigint>>, items array<string>")
    else:
        scratch, hits = Scratch(spark, "benchmark"), None
        for k in range(rounds):
            patterns = sent(k)

            def look(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
                tables = build(patterns.value)
                schema = pa.schema([("h", pa.binary()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
                for batch in pieces(batches, "_text"):
                    texts = batch.column("_text").to_pylist()
                    rows = [(_digest(t), s, i) for t, _, s, i in zip(texts, *found(texts, tables), strict=True) if s]
                    if rows:
                        yield make(schema, *map(list, zip(*rows, strict=True)))

            part = docs.select(F.col(text).alias("_text")).mapInArrow(look, "h binary, spans array<array<bigint>>, items array<string>")
            part = scratch.write(part.dropDuplicates(["h"]))  # equal texts have equal hits
            patterns.destroy()
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("h").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                schema = pa.schema([("h", pa.binary()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
                yield make(schema, batch.column("h"), [_union(s) for s in batch.column("s").to_pylist()], batch.column("items").to_pylist())

        hits = scratch.write(hits.mapInArrow(joined, "h binary, spans array<array<bigint>>, items array<string>"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, where):
                schema = pa.schema([batch.schema.field("_key"), ("n_words", pa.int64()), ("h", pa.binary())])
                texts = column(batch, where).to_pylist()
                yield make(schema, batch.column("_key"), [len(words(t)) for t in texts], [_digest(t) for t in texts])

        made = source.mapInArrow(count, f"_key {kind}, n_words bigint, h binary").join(hits, "h", "left")
        none = lambda c, of: F.coalesce(c, F.array().cast(of)).alias(c)
        made = made.select("_key", "n_words", none("spans", "array<array<bigint>>"), none("items", "array<string>"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return made.withColumn("n_hit", hit).select(carried(key, carry), "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def _digest(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode()).digest()


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
