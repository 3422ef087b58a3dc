"""Operator 8: byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are the leaves of a tree. The leaf of a symbol holds the rank of the pair
that it forms with the next living symbol; each inner node holds the least of its children, ties
to the left. The root therefore names the leftmost pair of the lowest rank. A merge changes three
leaves, each in a logarithmic number of steps, until the root shows that no pair can be merged.
"""

from __future__ import annotations

import array
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import carried, column, keyed, make, pieces

#: The pre-tokenizer's pattern of byte-level BPE vocabularies of this family. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What it amounts to in texts of ASCII only, where the standard library's matcher is faster.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
NONE = 1 << 60
POSITION_BITS = 36
PLACE = (1 << POSITION_BITS) - 1
#: Distinct pre-tokens kept encoded in a worker; the table starts anew beyond that.
CACHE_TOKENS = 500_000
#: Longer pre-tokens are encoded anew each time, so that the cache is bounded in bytes too.
CACHED_LETTERS = 64
ID_BITS = 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible in Latin-1, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def merge(ids: list[int], ranks: dict[int, int], merged: dict[int, int]) -> list[int]:
    """The symbols of one pre-token after all merges, by a segment tree.

    ranks: rank << POSITION_BITS of each pair (left << ID_BITS | right); merged: the symbol it becomes.
    The tree lies in one list: the leaf of symbol i at n + i, the children of node k at 2k and 2k + 1.
    A leaf's value is rank and position in one number, so the least is the leftmost of the lowest rank.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    tree = [NONE] * n
    tree += [get(x << ID_BITS | y, NONE) + i for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False))]
    tree.append(NONE)
    for k in range(n - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < NONE:
        i = root & PLACE
        j = after[i]
        ids[i] = new = merged[ids[i] << ID_BITS | ids[j]]
        ids[j] = -1
        after[i] = right = after[j]
        changes = [(n + j, NONE), (n + i, NONE)]
        if right < n:
            before[right] = i
            changes[1] = (n + i, get(new << ID_BITS | ids[right], NONE) + i)
        left = before[i]
        if left >= 0:
            changes.append((n + left, get(ids[left] << ID_BITS | new, NONE) + left))
        for k, value in changes:
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    return [x for x in ids if x >= 0]


class Codec(dict):
    """A vocabulary; as a mapping, packed identifiers (unsigned 32-bit, little-endian) by pre-token."""

    def __init__(self, spec: dict, cache_tokens: int = CACHE_TOKENS):
        super().__init__()
        self.cache_tokens = cache_tokens
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.first = [vocab[c] for c in letters]
        self.ranks, self.merged = {}, {}
        for rank, (a, b) in enumerate(pairs):
            pair = vocab[a] << ID_BITS | vocab[b]
            self.ranks.setdefault(pair, rank << POSITION_BITS)
            self.merged.setdefault(pair, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda s: [s]

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.cache_tokens:
            self.clear()
        first = self.first
        ids = merge([first[b] for b in token.encode()], self.ranks, self.merged)
        packed = array.array("I", ids)
        value = packed.tobytes()
        if len(token) <= CACHED_LETTERS:
            self[token] = value
        return value

    def encode(self, text: str) -> bytes:
        get, find = self.__getitem__, self.find_ascii if text.isascii() else self.find
        out = []
        for part in self.cut(text) if any(a in text for a in self.added) else (text,):
            out += [self.added[part].to_bytes(4, "little")] if part in self.added else map(get, find(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array.array("I", packed))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(spec: str, cache_tokens: int = CACHE_TOKENS) -> Codec:
    return Codec(json.loads(spec), cache_tokens)


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, cache_tokens: int = CACHE_TOKENS) -> DataFrame:
    """Each text's identifiers and what they decode to: key (or the columns named by carry, untouched, as a struct `row`), n_tokens, token_bytes, decoded, round_trip.

    `vocabulary` is the path, on the driver, of a byte-level BPE file; its content travels with the
    tasks (1.6 MB, bounded by the vocabulary, not by the data). token_bytes holds the identifiers as
    little-endian unsigned 32-bit integers. Null and empty texts have no tokens and decode to ''.
    Texts of any length are whole; every row gives one row. No exchange: rows are independent.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    source, where = keyed(docs, key, text, carry)
    kind = source.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = codec(spec.value, cache_tokens), None
        for batch in pieces(batches, where, 4 << 20):
            schema = schema or pa.schema([batch.schema.field("_key"), ("n_tokens", pa.int64()), ("token_bytes", pa.binary()), ("decoded", pa.string()), ("round_trip", pa.bool_())])
            texts = [t or "" for t in column(batch, where).to_pylist()]
            packed = [own.encode(t) for t in texts]
            decoded = [own.decode(p) for p in packed]
            yield make(schema, batch.column("_key"), [len(p) // 4 for p in packed], packed, decoded, [a == b for a, b in zip(texts, decoded, strict=True)])

    out = source.mapInArrow(run, f"_key {kind}, n_tokens bigint, token_bytes binary, decoded string, round_trip boolean")
    return out.select(carried(key, carry), "n_tokens", "token_bytes", "decoded", "round_trip")


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    out = encode_decode(docs, vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2(F.col("token_bytes"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
