"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents become token pieces of at most one sequence; only the first piece of a document can be short. Pieces
are dealt over partitions, each of which runs best-fit decreasing. Dual feasible functions give each partition
a lower bound on its bins. Where a partition misses its bound, its bins that are not full are opened and their
pieces exchanged with those of other partitions; the others give their emptiest bin. Best-fit decreasing runs
again on the exchanged pieces, and its result is taken only where it needs fewer bins.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.bpe import _OTHER, PRETOKEN, BoundedCache, Splitter, tokenizer_file
from siltworks.llm.common import discard, materialise

#: Pieces that one partition packs; a fixed bound on a task's memory.
PIECES_PER_PARTITION = 20_000
#: How often partitions with gaps exchange pieces.
ROUNDS = 2

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, pos long"


class Encoder(Splitter):
    """Token ids as little-endian unsigned 32-bit bytes, remembered by pre-token."""

    def __init__(self, path: str):
        super().__init__(path)
        self.spec = None
        self.words = BoundedCache(lambda w: array("I", self.library.encode(w, add_special_tokens=False).ids).tobytes())

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text) or self.segments(text)[1]:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.words.all(PRETOKEN.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """The first piece may be shorter; all others fill a sequence."""
    first = n % capacity or min(n, capacity)
    return [first] + [capacity] * ((n - first) // capacity) if n else []


def tokenised_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str, path: str | None) -> DataFrame:
    """One row per piece. ``pos`` numbers the rows of a task, so that repeated documents spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or tokenizer_file(tokenizer))
        BoundedCache.claim(enc.words)
        end, pos = array("I", [end_id]).tobytes(), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, start = memoryview(enc.ids(text or "") + end), 0
                for k, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), pos))
                    start += length
                    pos += 1
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "pos"])


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins.

    Bins wait in one stack per free room; a bit mask of the rooms in use finds the tightest in O(capacity / 64).
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fits := mask >> need:
            room = need + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - need:
            waiting[left].append(b)
            mask |= 1 << left
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least bins for ``counts[length]`` pieces, by two families of dual feasible functions.

    Cut(t): lengths over capacity - t count as a whole bin, lengths under t as nothing. Round(k): a length
    counts as floor((k + 1) * length / capacity) / k of a bin, or as itself where that product is whole.
    """
    sizes = np.arange(capacity + 1)
    have = np.flatnonzero(counts)
    if not len(have):
        return 0
    x, c = sizes[have], counts[have].astype(np.int64)
    best = -(-int((x * c).sum()) // capacity)
    mass, number = np.concatenate([[0], np.cumsum(counts * sizes)]), np.concatenate([[0], np.cumsum(counts)])
    for t in range(1, capacity // 2 + 1):
        whole = number[-1] - number[capacity - t + 1]
        part = mass[capacity - t + 1] - mass[t]
        best = max(best, int(whole) + -(-int(part) // capacity))
    for k in range(2, 21):
        product = (k + 1) * x
        # In units of 1 / (k * capacity) of a bin, so that all is whole numbers.
        share = np.where(product % capacity == 0, k * x, (product // capacity) * capacity)
        best = max(best, -(-int((share * c).sum()) // (k * capacity)))
    return best


PACKED_SCHEMA = PIECE_SCHEMA + ", part long, bin long, offset long, fill long, part_bins long, part_bound long"


def _pack_parts(pieces: DataFrame, capacity: int) -> DataFrame:
    """Best-fit decreasing of each ``part``, with its bins and its lower bound on every row."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        # A defined order, whatever order the shuffle brought.
        pdf = pdf.sort_values(["length", "doc_id", "piece", "pos"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return pdf.assign(bin=bins, offset=offsets, fill=fill[bins], part_bins=used, part_bound=bound)

    return pieces.groupBy("part").applyInPandas(pack, PACKED_SCHEMA)


def pack_documents(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    tokenizer: str = "byte_bpe_50k.json",
    path: str | None = None,
    rounds: int = ROUNDS,
    pieces_per_partition: int = PIECES_PER_PARTITION,
) -> DataFrame:
    """Pack the token ids of ``doc_id, text`` into sequences of ``capacity`` tokens.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Longer documents are cut
    so that all pieces but the first fill a sequence; those take a sequence each. Returns a row per piece with
    doc_id, piece, start, length, ids_crc32, sequence_id, offset, and as the certificate of the partition that
    packed it ``part_bins`` and ``part_bound`` (its bins and their lower bound; 1 and 1 for full pieces).
    Repeated rows are packed as often as they occur; rows of null id too. An empty table gives no rows. Other
    columns of the input are not read.
    """
    pieces = materialise(tokenised_pieces(docs, capacity, end_id, tokenizer, path))
    full = pieces.filter(F.col("length") == capacity)
    short = pieces.filter(F.col("length") < capacity)
    parts = max(1, -(-short.count() // pieces_per_partition))
    short = short.withColumn("part", F.pmod(F.xxhash64("doc_id", "pos", "ids_crc32"), F.lit(parts)))
    packed = _pack_parts(short, capacity).withColumn("round", F.lit(0))
    settled: list[DataFrame] = []
    if parts > 1:
        packed = materialise(packed)
        for k in range(1, rounds + 1):
            kept, packed = _exchange(packed, capacity, k, pieces_per_partition)
            settled.append(kept)
            if packed is None:
                break
    if packed is not None:
        settled.append(packed)
    # Sequence numbers: round, partition and bin side by side; those of full pieces are negative.
    number = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft("part", 24) + F.col("bin")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    certificate = ["part_bins", "part_bound"]
    out = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *[F.lit(1).cast("long").alias(c) for c in certificate])
    for df in settled:
        out = out.unionByName(df.select(*columns, number.alias("sequence_id"), "offset", *certificate))
    return out


def _exchange(packed: DataFrame, capacity: int, turn: int, pieces_per_partition: int) -> tuple[DataFrame, DataFrame | None]:
    """Settled bins, and the exchanged pieces packed anew (None when that saves nothing)."""
    fills = packed.groupBy("part", "bin").agg(F.first("fill").alias("fill"), F.first("part_bins").alias("part_bins"), F.first("part_bound").alias("part_bound"))
    emptiest = fills.groupBy("part").agg(F.min(F.struct("fill", "bin"))["bin"].alias("emptiest"))
    opened = (
        fills.join(emptiest, "part")
        .filter(F.when(F.col("part_bins") > F.col("part_bound"), F.col("fill") < capacity).otherwise(F.col("bin") == F.col("emptiest")))
        .select("part", "bin", F.lit(True).alias("opened"))
    )
    marked = packed.join(opened, ["part", "bin"], "left")
    marked = materialise(marked)
    discard(packed)
    kept, moved = marked.filter("opened is null").drop("opened"), marked.filter("opened").drop("opened")
    before = moved.select("part", "bin").distinct().count()
    if before < 2:
        return marked.drop("opened"), None
    parts = max(1, -(-moved.count() // pieces_per_partition))
    dealt = moved.select("doc_id", "piece", "start", "length", "ids_crc32", "pos", F.pmod(F.xxhash64("doc_id", "pos", "ids_crc32", F.lit(turn)), F.lit(parts)).alias("part"))
    again = materialise(_pack_parts(dealt, capacity).withColumn("round", F.lit(turn)))
    if again.select("part", "bin").distinct().count() >= before:
        return marked.drop("opened"), None
    return kept, again


def packing_certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """Sequences in use and the least possible number, from the counts of the at most ``capacity`` lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return packed.select("sequence_id").distinct().count(), lower_bound(counts, capacity)
