"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines inside buckets.

A vector falls into one bucket of each table, named by the signs of its products with that table's random
directions. Vectors of one bucket are first compared in blocks by SIGNS of their signs alone, 32 bytes each; only
those with a partner whose signs allow the threshold go on, with all components, to a matrix product in double
precision. A pair that meets in several tables counts in the first alone, which both vectors' bucket numbers show
without a join. A block reports its vectors' numbers of links and a spanning forest of them, so no bucket is
expanded to pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.common import discard, materialise
from siltworks.llm.components import connected_components

#: Probability, over tables, that a pair exactly at the threshold meets in no bucket.
MISS = 1e-4
#: Signs of a vector that its buckets compare first, and the standard deviations by which they may differ more than
#: those of a pair at the threshold do: more than one in 1e9 such pairs.
SIGNS, DEVIATIONS = 256, 6.5
#: Vectors of a block: a comparison holds two blocks.
BLOCK = 512
#: Vectors wanted per bucket, and rows wanted per group of buckets that a task takes at once.
BUCKET_SIZE, CELL_ROWS = 128, 8192


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table, so that unrelated vectors share buckets of about BUCKET_SIZE, and tables for ``miss``."""
    bits = min(30, max(4, round(math.log2(max(n, 1) / BUCKET_SIZE))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def directions(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * bits))


def _rows(column: pa.Array, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dim`` components as stored, and which of them are whole; ``column`` holds none of another length but nulls."""
    rows, there = np.zeros((len(column), dim), kind), column.is_valid().to_numpy(zero_copy_only=False)
    there &= pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) == dim
    values = column.filter(pa.array(there)).flatten()
    gaps = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
    rows[there] = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).reshape(-1, dim)
    whole = there.copy()
    whole[there] = ~gaps
    return rows, whole


def _unit_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have a direction."""
    rows, usable = rows.astype(np.float64), np.ones(len(rows), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        # Scaled by the largest component first, so that squares neither overflow nor vanish.
        usable &= np.isfinite(rows).all(axis=1)
        rows[~usable] = 0
        top = np.abs(rows).max(axis=1, initial=0)
        usable &= top > 0
        rows /= np.where(usable, top, 1)[:, None]
        rows /= np.where(usable, np.sqrt((rows * rows).sum(axis=1)), 1)[:, None]
    return rows, usable


HASHED_SCHEMA = "vec_id long, dim int, raw binary, unit_key binary, codes array<int>, code_bytes binary, signs binary"


def _hashed(vectors: DataFrame, vec: str, kind: type, bits: int, tables: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, powers = lru_cache(maxsize=4)(lambda dim: directions(dim, bits, tables, seed)), 1 << np.arange(bits)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            # The vectors of each length; those of none once, as rows of one component that is not whole.
            for dim in np.unique(lengths):
                found = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                for at in range(0, found.num_rows, 4096):
                    yield of_length(found.slice(at, 4096), max(1, int(dim)), planes, powers)

    def of_length(part: pa.RecordBatch, dim: int, planes, powers: np.ndarray) -> pa.RecordBatch:
        stored, whole = _rows(part.column(1), dim, kind)
        rows, usable = _unit_rows(stored)
        usable &= whole
        signs = rows @ planes(dim) > 0
        codes = (signs.reshape(-1, tables, bits) @ powers).astype(np.int32)
        few = pa.array([x.tobytes() for x in np.packbits(signs[:, :SIGNS], axis=1)], pa.binary())
        raw = pa.array([r.tobytes() if u else None for r, u in zip(stored, usable)], pa.binary())
        keys = pa.array([xxhash.xxh3_128_digest(r.tobytes()) if u else None for r, u in zip(rows, usable)], pa.binary())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int32()))
        packed = pa.array([c.tobytes() for c in codes], pa.binary())
        dims = pa.array(np.full(part.num_rows, dim, np.int32))
        return pa.RecordBatch.from_arrays([part.column(0), dims, raw, keys, lists, packed, few], names=["vec_id", "dim", "raw", "unit_key", "codes", "code_bytes", "signs"])

    return vectors.select("vec_id", F.col(vec)).mapInArrow(run, HASHED_SCHEMA)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that each of n vertices reaches by the links a, b: pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


CELL_KEYS = ["dim", "bucket_table", "bucket", "lo", "hi"]


def _cells(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The pairs of blocks in a group of them, each with two vectors or more."""
    pdf = pdf.sort_values([*CELL_KEYS, "vec_id"], ignore_index=True)
    keys = pdf[CELL_KEYS].to_numpy()
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    yield from (pdf.iloc[a:b] for a, b in zip(starts, [*starts[1:], len(pdf)]) if b - a > 1)


def _apart(pdf: pd.DataFrame, rows: slice) -> np.ndarray:
    """Which pairs of the rows with all others a pair of blocks is to compare."""
    block, turn = pdf["block"].to_numpy(), np.arange(len(pdf))
    if pdf["lo"].iat[0] == pdf["hi"].iat[0]:
        return turn[rows, None] != turn[None, :]
    return block[rows, None] != block[None, :]


def _steps(n: int) -> Iterator[slice]:
    return (slice(at, min(at + 256, n)) for at in range(0, n, 256))


def most_differing(signs: int, threshold: float) -> int:
    """Signs in which a pair at the threshold differs, but for one in more than 1e9 of them."""
    p = math.acos(threshold) / math.pi
    return math.ceil(signs * p + DEVIATIONS * math.sqrt(signs * p * (1 - p)))


def _promising(most: int, bits: int):
    """The rows of pairs of blocks that have a partner there whose signs differ in ``most`` places at most, and that no earlier table showed them.

    The signs that travel hold the codes of the first tables; a pair that shares one of them is compared there already, so the vectors of
    a close group are sent out once and not for each table.
    """
    powers = 1 << np.arange(bits)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(pdf["signs"]), np.uint8).reshape(len(pdf), -1)
        # Unequal signs of two rows: a + b - 2ab, summed by a matrix product.
        told = np.unpackbits(signs, axis=1)
        met = min(int(pdf["bucket_table"].iat[0]), told.shape[1] // bits)
        codes = told[:, : met * bits].reshape(len(pdf), met, bits) @ powers
        told = told.astype(np.float32)
        ones, some = told.sum(axis=1), np.zeros(len(pdf), bool)
        for rows in _steps(len(pdf)):
            hope = (ones[rows, None] + ones[None, :] - 2 * (told[rows] @ told.T) <= most) & _apart(pdf, rows)
            for table in range(met):
                if not hope.any():
                    break
                hope &= codes[rows, table, None] != codes[None, :, table]
            some[rows] = hope.any(axis=1)
        return pdf[some].drop(columns="signs")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pdf.iloc[:0].drop(columns="signs"), *map(one, _cells(pdf))])

    return run


def _compare(kind: type, threshold: float):
    """Pairs of blocks of buckets: links per vector, and a spanning forest of each pair of blocks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame | None:
        ids, weights = pdf["vec_id"].to_numpy(), pdf["copies"].to_numpy()
        units = _unit_rows(np.frombuffer(b"".join(pdf["raw"]), kind).reshape(len(ids), -1))[0]
        codes = np.frombuffer(b"".join(pdf["code_bytes"]), np.int32).reshape(len(ids), -1)
        table = int(pdf["bucket_table"].iat[0])
        links, lefts, rights = np.zeros(len(ids), np.int64), [], []
        for rows in _steps(len(ids)):
            i, j = np.nonzero((units[rows] @ units.T >= threshold) & _apart(pdf, rows))
            if len(i):
                i = i + rows.start
                lefts.append(i)
                rights.append(j)
                # Counted where no earlier table holds the pair.
                new = (codes[i, :table] != codes[j, :table]).all(axis=1)
                np.add.at(links, i[new], weights[j[new]])
        if not lefts:
            return None
        root = _local_roots(len(ids), np.concatenate(lefts), np.concatenate(rights))
        some = (links > 0) | (root != np.arange(len(ids)))
        return pd.DataFrame({"vec_id": ids[some], "links": links[some], "root": ids[root[some]]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [x for cell in _cells(pdf) if (x := one(cell)) is not None]
        return pd.concat(found) if found else pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")

    return run


def near_embeddings(vectors: DataFrame, vec: str = "embedding", threshold: float = 0.95, seed: int = 0, miss: float = MISS) -> DataFrame:
    """Link vectors of ``vec_id, <vec>`` whose cosine is at least ``threshold``.

    Returns vec_id, n_links (other rows linked directly), component_id (the smallest vec_id reachable) and kept,
    a row per input row. Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths do not link with each other. Rows of one direction form a class that is compared once and
    counts with its copies. Repeated ids are one vertex. Rows of null vec_id come back unlinked with null
    component_id. An empty table gives no rows. Extra columns are not read.

    Bits and tables follow from the number of rows and ``miss``, the chance that a pair exactly at the threshold
    is missed; closer pairs are safer. Buckets above BLOCK vectors are compared block by block. What a table of
    buckets shuffles of a vector is its signs; components travel once per bucket in which a pair has hope.
    """
    source = vectors.filter("vec_id is not null")
    shape = source.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dim")).first()
    n, dim = shape["n"], max(shape["dim"] or 0, 0)
    columns = ["vec_id", "n_links", "component_id", "kept"]
    nothing = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n or not dim:
        return nothing
    bits, tables = plan_tables(n, threshold, miss)
    kind = np.float32 if isinstance(source.schema[vec].dataType.elementType, T.FloatType) else np.float64
    hashed = materialise(_hashed(source, vec, kind, bits, tables, seed))
    usable = hashed.filter("raw is not null")
    # Each class has a number of its own, as an id can lead several.
    classes = usable.groupBy("dim", "unit_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("vertex", F.monotonically_increasing_id()))
    membership = materialise(usable.select("vec_id", "dim", "unit_key").join(classes, ["dim", "unit_key"]).select("vec_id", "vertex", "rep", "copies"))
    leaders = classes.withColumnRenamed("rep", "vec_id")
    reps = usable.join(leaders, ["dim", "unit_key", "vec_id"]).dropDuplicates(["vertex"])
    reps = materialise(reps.select(F.col("vertex").alias("vec_id"), "copies", "dim", "raw", "codes", "code_bytes", "signs"))

    places = reps.select("vec_id", "dim", "signs", F.posexplode("codes").alias("bucket_table", "bucket"))
    # Written out, so that the join below stands alone and a hot bucket can be split.
    sizes = materialise(places.groupBy("dim", "bucket_table", "bucket").agg(F.count("*").alias("members")).filter("members > 1"))
    placed = places.join(sizes, ["dim", "bucket_table", "bucket"]).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "bucket_table"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    cell = F.pmod(F.xxhash64("dim", "bucket_table", "bucket", "lo", "hi"), F.lit(max(1, n * tables // CELL_ROWS)))
    dealt = dealt.select("vec_id", "dim", "bucket_table", "bucket", "block", "lo", "hi", cell.alias("cell"), "signs")
    most, kept = most_differing(min(SIGNS, tables * bits), threshold), "vec_id long, dim int, bucket_table int, bucket int, block int, lo int, hi int, cell long"
    hopeful = materialise(dealt.groupBy("cell").applyInPandas(_promising(most, bits), kept))
    discard(sizes)
    whole = hopeful.join(reps.select("vec_id", "copies", "raw", "code_bytes"), "vec_id")
    found = materialise(whole.groupBy("cell").applyInPandas(_compare(kind, threshold), "vec_id long, links long, root long"))

    discard(reps, hopeful)
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "vertex")
    # Copies take their class's component by a join, so that they add no edges; ids with several vectors tie theirs.
    several = membership.groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("vec_id", "low")
    ties = membership.join(several, "vec_id").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    end = lambda vertex, name: classes.select(F.col("vertex").alias(vertex), F.col("rep").alias(name))
    edges = found.select("vec_id", "root").filter("vec_id <> root").distinct().join(end("vec_id", "u"), "vec_id").join(end("root", "v"), "root").select("u", "v")
    component = connected_components(edges.unionByName(ties))
    discard(classes)
    linked = membership.join(counts, "vertex", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    linked = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    linked = linked.groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = hashed.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.unionByName(nothing.filter("vec_id is null")).select(*columns)


#: The query in DuckDB: cosines of all pairs, and their closure.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(vec_id, least) AS (
  SELECT a, b FROM links UNION SELECT l.a, r.least FROM links l JOIN reach r ON l.b = r.vec_id
), low AS (
  SELECT vec_id, min(least) AS least FROM reach GROUP BY vec_id
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce(low.least, v.vec_id)) AS component_id,
  least(v.vec_id, coalesce(low.least, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN low ON v.vec_id = low.vec_id
"""
