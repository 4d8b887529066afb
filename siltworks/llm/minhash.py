"""Near-duplicate documents by HyperMinHash, banding and verification on full shingle sets.

One hash per shingle picks one of the sketch's buckets and gives a value; a bucket keeps its least value as a
register of 6 bits for the leading zeros and 10 bits of mantissa. Bands of registers propose pairs, the
collision-corrected Jaccard estimate of two sketches drops hopeless ones, and the pairs left are verified on
their full shingle sets.

Only connectivity has to be exact, so no bucket is expanded into all its pairs. Equal sets collapse into one
class. Each bucket first links its members to its least one. What then still lies in several components of a
bucket is compared inside a task, in blocks of bounded size: sketches first, full sets of those with hope, and
only members of different components. A task reports the links that join components, at most one per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.bpe import BoundedCache
from siltworks.llm.common import discard, materialise
from siltworks.llm.components import connected_components

#: 42 bands of 6: two sets of similarity 0.8 miss all bands with probability (1 - 0.8 ** 6) ** 42 = 3e-6.
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Chance that two different values give one register: equal leading zeros (1/3) and equal mantissas.
COLLISION = 2.0**-MANTISSA_BITS / 3
#: Standard deviations by which a sketch's estimate may fall short of the threshold.
MARGIN = 5.0
#: Members of a block of a bucket and shingles of all of them; rows and shingles of the blocks that a task takes at once.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
CELL_ROWS, CELL_SHINGLES = 4096, 4_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


_WORDS = BoundedCache(lambda w: xxhash.xxh3_64_intdigest(w), 200_000)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; A-Z count as a-z.

    ``bytes.split`` cuts at space, tab, LF, VT, FF and CR, ``bytes.lower`` changes A-Z alone. Fewer words
    make one shingle of all; no words make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array(_WORDS.all(words), np.uint64)
    n, out = max(1, len(codes) - size + 1), np.zeros(1, np.uint64)
    for i in range(min(size, len(codes))):
        out = mix(out * _M2 + codes[i : i + n], i)
    # A shorter sequence can't meet a full shingle: its length enters the hash.
    return np.unique(mix(out, min(size, len(codes))))


@lru_cache(maxsize=1)
def _borrowing() -> np.ndarray:
    """For each register the order in which it looks for a filled one while it is empty."""
    return np.argsort(np.random.default_rng(20).random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)


_BAND_FACTORS = np.random.default_rng(21).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16, 0: empty) of sorted shingle hashes."""
    registers = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        # Sorted hashes have sorted buckets, so each bucket is one stretch.
        bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        least = np.minimum.reduceat(mix(hashes, 7) >> np.uint64(12), starts)
        fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
        zeros = 52 - exponent
        mantissa = ((2 * fraction - 1) * 2**MANTISSA_BITS).astype(np.uint16)
        registers[bucket[starts].astype(np.int64)] = ((zeros + 1).astype(np.uint16) << MANTISSA_BITS) | mantissa
    return registers


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A signed 64-bit key per band; empty registers borrow from filled ones in a fixed random order."""
    filled = registers.copy()
    empty = np.flatnonzero(registers == 0)
    for width in (16, REGISTERS):
        if not len(empty):
            break
        probes = _borrowing()[empty, :width]
        there = registers[probes] != 0
        found = there.any(axis=1)
        filled[empty[found]] = registers[probes[found, there[found].argmax(axis=1)]]
        empty = empty[~found]
    keys = (filled.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * _M2, 11).view(np.int64)


def estimated_jaccard(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimates of rows of registers, and how many buckets speak in each."""
    either = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1) / np.maximum(either, 1)
    return np.clip((equal - COLLISION) / (1 - COLLISION), 0, 1), either


def hopeful(a: np.ndarray, b: np.ndarray, threshold: float, margin: float) -> np.ndarray:
    estimate, either = estimated_jaccard(a, b)
    return estimate >= threshold - margin * np.sqrt(threshold * (1 - threshold) / np.maximum(either, 1))


def banded(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the 128-bit key of the set, and band keys of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        BoundedCache.claim(_WORDS)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), size)
                sizes.append(len(hashes))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(band_keys(sketch(hashes)) if len(hashes) else np.zeros(0, np.int64))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """vertex, n_shingles, registers and packed text of the documents ``text, vertex, set_key`` that have that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        BoundedCache.claim(_WORDS)
        for batch in batches:
            rows = []
            for text, vertex, key in zip(batch.column("text"), batch.column("vertex").to_pylist(), batch.column("set_key").to_pylist()):
                hashes = shingle_set(text := text.as_py(), size)
                # An id with several texts has rows of other sets.
                if xxhash.xxh3_128_digest(hashes.tobytes()) == key:
                    rows.append((vertex, len(hashes), sketch(hashes).tobytes(), pack.compress(text.encode("utf-8", "surrogatepass"))))
            columns = list(zip(*rows)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_shingles", "sketch", "packed"])

    return docs.select("text", "vertex", "set_key").mapInArrow(run, "doc_id long, n_shingles long, sketch binary, packed binary")


def _hopeful_pairs(pairs: DataFrame, sketches: DataFrame, percent: int, margin: float) -> DataFrame:
    """Pairs a, b whose sizes and sketches allow the threshold."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            keep = pa.array(hopeful(a, b, percent / 100, margin))
            yield batch.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def _unpacked_set(packed: bytes, size: int) -> np.ndarray:
    return shingle_set(zstandard.decompress(packed).decode("utf-8", "surrogatepass"), size)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs a, b those whose full shingle sets reach the threshold."""
    ta, tb = (texts.select(F.col("doc_id").alias(x), F.col("packed").alias(f"t{x}")) for x in "ab")
    # Members meet their own text first; the least document of a large group then goes to many pairs.
    both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last:
                    last, left = a, _unpacked_set(ta.as_py(), size)
                right = _unpacked_set(tb.as_py(), size)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(run, "a long, b long"))


def _open_blocks(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members ``key, doc_id, n_shingles`` of buckets that lie in several components, dealt to pairs of blocks.

    Returns key, lo, hi, doc_id, component, block. The members outside a bucket's largest component fill the first
    blocks and meet each other and all others; those inside it meet only the first blocks. Long documents make
    blocks of fewer members.
    """
    placed = members.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("components")).filter("components > 1")
    number = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, F.least(n, shingles / BLOCK_SHINGLES))).cast("int")
    rest, most = [number(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")), number(F.col("most.n"), F.col("most.s"))]
    # Written out, so that the join below stands alone and a hot bucket can be split.
    buckets = materialise(buckets.select("key", F.col("most.component").alias("largest"), rest.alias("few"), most.alias("many")))
    placed = placed.join(buckets, "key").withColumn("inside", F.col("component") == F.col("largest"))
    turn = F.xxhash64("doc_id")
    placed = placed.withColumn("block", F.when(F.col("inside"), F.col("few") + F.pmod(turn, "many")).otherwise(F.pmod(turn, "few")).cast("int"))
    last = F.when(F.col("inside"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return placed.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc_id", "component", "block")


def _by_cell(rows: DataFrame, cells: int, work, schema: str) -> DataFrame:
    """Run ``work`` on the rows of each (key, lo, hi), dealt to ``cells`` groups of them that a task takes at once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "lo", "hi", "doc_id"], ignore_index=True)
        keys = pdf[["key", "lo", "hi"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        return pd.concat([empty, *(work(pdf.iloc[a:b]) for a, b in zip(starts, [*starts[1:], len(pdf)]) if b - a > 1)])

    empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in schema.split(", ")})
    return rows.withColumn("cell", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(cells))).groupBy("cell").applyInPandas(run, schema)


def _block_links(blocks: DataFrame, met: DataFrame, size: int, percent: int, margin: float) -> DataFrame:
    """Links a, b that join components inside blocks, found on full sets; at most one per member of a block."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, block, within = pdf["doc_id"].to_numpy(), pdf["block"].to_numpy(), pdf["lo"].iat[0] == pdf["hi"].iat[0]
        registers = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(-1, REGISTERS)
        comp = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
        # The largest component needs no turn of its own: the others look for links to it.
        turns, partners = np.flatnonzero(comp != np.bincount(comp).argmax()), {}
        for i in turns:
            rest = np.flatnonzero((comp != comp[i]) & (within | (block != block[i])))
            if len(rest := rest[hopeful(registers[i], registers[rest], percent / 100, margin)]):
                partners[i] = rest
        if not partners:
            return empty
        # An index of shingles to members; one count per member then gives all its intersections.
        needed = np.unique(np.concatenate([list(partners), *partners.values()]))
        sets = dict(zip(needed, (_unpacked_set(x, size) for x in pdf["packed"].iloc[needed])))
        sizes = np.zeros(len(ids), np.int64)
        sizes[needed] = [len(sets[i]) for i in needed]
        owners, shingles = np.repeat(needed, sizes[needed]), np.concatenate(list(sets.values()))
        order = np.argsort(shingles, kind="stable")
        shingles, owners = shingles[order], owners[order]
        a, b = [], []
        for i, rest in partners.items():
            lo, hi = np.searchsorted(shingles, sets[i], "left"), np.searchsorted(shingles, sets[i], "right")
            spans = hi - lo
            at = np.repeat(lo - np.r_[0, spans.cumsum()[:-1]], spans) + np.arange(spans.sum())
            common = np.bincount(owners[at], minlength=len(ids))[rest]
            for j in rest[100 * common >= percent * (sizes[i] + sizes[rest] - common)]:
                if comp[j] != comp[i]:
                    a.append(ids[i])
                    b.append(ids[j])
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    dealt = materialise(blocks)
    whole = dealt.join(met, "doc_id")
    of = whole.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    cells = 1 + max(of["rows"] // CELL_ROWS, of["shingles"] // CELL_SHINGLES)
    found = materialise(_by_cell(whole, cells, work, "a long, b long"))
    discard(dealt)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, margin: float = MARGIN) -> DataFrame:
    """Link documents of ``doc_id, text`` whose sets of ``size``-word shingles have 100 * common >= percent * union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id =
    component_id), a row per input row. Null, empty and blank texts have no shingles and no links; texts with
    fewer words have one shingle. Rows of null doc_id come back unlinked with null component_id and kept true.
    Rows that repeat an id are one vertex with the links of each. Copies form one class and never pairs.
    Extra columns are not read. An empty table gives no rows.

    Pairs that share a band go on to their full sets unless the sketches' estimate is more than ``margin`` standard
    deviations short of the threshold; an infinite margin sends all of them on.
    """
    docs = docs.select("doc_id", "text")
    everything = materialise(banded(docs.filter("doc_id is not null"), size))
    filled = everything.filter("n_shingles > 0")
    # Written out, so that the join below stands alone and its hot keys can be split.
    # Each class has a number of its own, as an id can lead several; up to the links it stands in the place of doc_id.
    classes = materialise(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")).withColumn("vertex", F.monotonically_increasing_id()))
    leaders = classes.select("set_key", F.col("rep").alias("doc_id"), "vertex")
    rows = filled.select("set_key", "doc_id", "bands").join(leaders, ["set_key", "doc_id"]).select(F.explode("bands").alias("key"), F.col("vertex").alias("doc_id"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).filter("lead < last").select("key", "lead")
    buckets = materialise(buckets)
    members = materialise(rows.join(buckets, "key").filter("doc_id <> lead"))
    # The sketch and text of one document per class that shares a bucket; most share none, so that neither is kept for all.
    meeting = members.select(F.col("doc_id").alias("vertex")).unionByName(buckets.select(F.col("lead").alias("vertex"))).distinct()
    chosen = materialise(leaders.join(meeting, "vertex"), merge=True)
    met = materialise(sketched(docs.join(chosen, "doc_id"), size).dropDuplicates(["doc_id"]))
    discard(buckets, chosen)
    # Copies take their class's component by a join, so that they add no edges; ids with several texts tie theirs.
    placed = everything.select("doc_id", "n_shingles", "set_key").join(classes.drop("vertex"), "set_key", "left")
    placed = materialise(placed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")))
    discard(everything)

    stars = members.select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    hope = materialise(_hopeful_pairs(stars, met, percent, margin))
    star_links = _verified(hope, met, size, percent)
    discard(hope)
    component = connected_components(star_links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    sized = members.select("key", "doc_id").join(met.select("doc_id", "n_shingles"), "doc_id")
    block_links = _block_links(_open_blocks(sized, component), met, size, percent, margin)
    discard(members, met, component)
    found = [star_links, block_links]

    several = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("doc_id", "low")
    ties = placed.join(several, "doc_id").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    end = lambda vertex, name: classes.select(F.col("vertex").alias(vertex), F.col("rep").alias(name))
    edges = reduce(DataFrame.unionByName, found).join(end("a", "u"), "a").join(end("b", "v"), "b").select("u", "v")
    component = connected_components(edges.unionByName(ties))
    out = placed.join(component.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = out.select("doc_id", "n_shingles", "component")
    discard(classes, *found)
    unnamed = docs.filter("doc_id is null")
    if unnamed.take(1):
        nameless = banded(unnamed.withColumn("doc_id", F.lit(0).cast("long")), size)
        out = out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component")))
    component_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


#: The query of two-word shingles in DuckDB: all pairs that share a shingle, and their closure.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, least) AS (
  SELECT a, b FROM links UNION SELECT l.a, r.least FROM links l JOIN reach r ON l.b = r.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.least), s.doc_id)) AS component_id,
  least(s.doc_id, coalesce(min(r.least), s.doc_id)) = s.doc_id AS kept
FROM sets s LEFT JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s
"""
