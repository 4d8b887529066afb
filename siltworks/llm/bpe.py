"""Byte-pair token counts without token ids.

``MergeCounter`` counts the tokens of a text as a byte-level BPE vocabulary splits it: the text is cut into
pre-tokens, each pre-token becomes one symbol per UTF-8 byte, and a heap with a doubly linked list pops the
adjacent pair of lowest merge rank (leftmost first among equal ranks) until no pair can merge. The count is
the initial symbols minus the merges done; ids are never built.
"""

from __future__ import annotations

import heapq
import json
import re
import weakref
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters for which the pre-token pattern below is written out. Texts with others go to the library's own splitter.
_PLAIN = r"\t-\r -~\xa0-ɏ"
_OTHER = re.compile(f"[^{_PLAIN}]")
#: Of those: letters, numbers and white space.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \xa0"
PRETOKEN = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: Pre-tokens remembered by one Python worker at most, and the longest one that is remembered.
CACHE_ENTRIES, CACHE_CHARS = 700_000, 40


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible, else the next free code point from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BoundedCache(dict):
    """Values by word; ``make`` computes the missing ones. It keeps ``entries`` and one text's at most.

    A Python worker serves one operator after another; ``claim`` empties the caches of the operators before.
    """

    __hash__ = object.__hash__
    __eq__ = object.__eq__
    _all: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries
        self._all.add(self)

    @classmethod
    def claim(cls, *used: BoundedCache) -> None:
        for cache in list(cls._all):
            if not any(cache is u for u in used):
                cache.clear()

    def all(self, keys: list) -> list:
        """The values of ``keys``: one pass of plain look-ups, then those that are missing."""
        values = list(map(self.get, keys))
        if None in values:
            if len(self) > self.entries:
                self.clear()
            for i, value in enumerate(values):
                if value is None:
                    key = keys[i]
                    if (value := self.get(key)) is None:
                        value = self.make(key)
                        if len(key) <= CACHE_CHARS:
                            self[key] = value
                    values[i] = value
        return values


class Splitter:
    """Cuts a text into special strings and pre-tokens as the library does by default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        for token in self.spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token with context rules isn't supported: {token}")
        before = self.spec["pre_tokenizer"] or {}
        if (
            self.spec["normalizer"]
            or before.get("type") != "ByteLevel"
            or before.get("add_prefix_space")
            or not before.get("use_regex")
            or self.spec["model"]["type"] != "BPE"
        ):
            raise ValueError("only byte-level BPE vocabularies without a normaliser are supported")
        specials = sorted((t["content"] for t in self.spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def segments(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many special strings there are."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1


class MergeCounter(Splitter):
    def __init__(self, path: str):
        super().__init__(path)
        merges = self.spec["model"]["merges"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges)
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.spec = None
        self.alphabet = byte_alphabet()
        self.plain = BoundedCache(lambda word: self.tokens_of("".join(map(self.alphabet.__getitem__, word.encode()))))
        self.mapped = BoundedCache(self.tokens_of)

    def tokens_of(self, symbols: str) -> int:
        """Initial symbols minus merges of one pre-token, given in stand-in characters."""
        n = len(symbols)
        if n < 2:
            return n
        ranks, piece = self.ranks, list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            # An entry is stale once either of its symbols has changed or gone.
            if piece[i] is None or (j := after[i]) >= n or ranks.get((piece[i], piece[j])) != rank:
                continue
            whole = piece[i] + piece[j]
            piece[i], piece[j] = whole, None
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (rank := ranks.get((whole, piece[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := ranks.get((piece[h], whole))) is not None:
                heapq.heappush(heap, (rank, h))
        return n - merges

    def count(self, text: str) -> int:
        parts, total = self.segments(text)
        for part in parts:
            if _OTHER.search(part):
                total += sum(self.mapped.all([p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]))
            else:
                total += sum(self.plain.all(PRETOKEN.findall(part)))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    path: str | None = None,
    n_bytes: str = "n_bytes",
    n_tokens: str = "n_tokens",
) -> DataFrame:
    """Add UTF-8 bytes and BPE tokens of a text column; one pass, no shuffle.

    ``tokenizer`` names a file of the public tokenizers, resolved on each executor; ``path`` gives a file
    instead. Null and empty texts have 0 bytes and 0 tokens; whole texts of any length are counted; a
    text without white space is one pre-token, merged in O(n log n). Rows are independent, so repeated rows
    and empty tables need no rule. Columns of the input are kept; ones already called like an output are
    replaced.
    """
    kept = [c for c in docs.columns if c not in (n_bytes, n_tokens)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.withColumns({n_bytes: F.lit(0).cast("long"), n_tokens: F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(path or tokenizer_file(tokenizer))
        BoundedCache.claim(bpe.plain, bpe.mapped)
        for batch in batches:
            texts = [t or "" for t in batch.column(kept.index(text)).to_pylist()]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            counts = pa.array([bpe.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, counts], names=[*kept, n_bytes, n_tokens])

    return source.mapInArrow(run, schema)


def token_report(docs: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    A row per input row, whatever its id; null texts are empty ones, of 0 bytes and tokens. Equal texts have equal
    counts. Texts of any length count whole. An empty table gives no rows; extra columns are not read.
    """
    counted = count_tokens(docs.select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
