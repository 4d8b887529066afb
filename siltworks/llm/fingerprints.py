"""I-Match fingerprints over several randomised lexicons.

The lexicon holds the terms whose document frequency lies in a band: frequent ones say nothing of a document,
rare ones are typing errors and names. Each of several random subsets of it gives one hash, of the document's
distinct terms in the subset, sorted. Subsets come in densities from the whole lexicon to a 1024th of it: sparse ones
survive changes to long texts, dense ones speak for short texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TERM = re.compile(r"\w+")
#: Least and greatest share of documents that a term of the lexicon is in. At most 1 / LOW times the mean
#: number of terms of a document can be in so many, so the lexicon does not grow with the corpus.
LOW, HIGH = 0.001, 0.25
#: Subsets: how many hold one in 2 ** bits of the lexicon's terms (the first is the whole lexicon); hexadecimal digits of a hash.
BITS = {0: 1, 2: 2, 4: 4, 6: 12, 8: 24, 10: 24}
SUBSETS, DIGITS = sum(BITS.values()), 8
EMPTY = "0" * DIGITS
#: Documents of a stretch of the id order that one task reads through, if that makes MOST_STRETCHES at most; a task
#: holds two documents at a time, so longer stretches take time, not memory.
STRETCH, MOST_STRETCHES = 2048, 20_000


def terms_of(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, n over all documents; a task's partial counts are bounded and summed after the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(terms_of(text.as_py()))
                if len(counts) > 500_000:
                    yield _partial(counts)
                    counts = Counter()
        yield _partial(counts)

    return docs.select(F.coalesce("text", F.lit(""))).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _partial(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def lexicon_of(docs: DataFrame, low: float = LOW, high: float = HIGH) -> frozenset[str]:
    """The terms in the band. ``low`` bounds their number: see LOW."""
    n = docs.count()
    band = document_frequencies(docs).filter((F.col("n") >= low * n) & (F.col("n") <= high * n))
    return frozenset(r.term for r in band.select("term").collect())


@dataclass
class Fingerprinter:
    lexicon: frozenset[str]

    def __post_init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def subsets(self, term: str) -> tuple[int, ...]:
        """The subsets that a term is in: those whose bits of its hashes are all zero."""
        found = self.known.get(term)
        if found is None:
            found, first = [], 0
            for bits, number in BITS.items():
                per = 64 // bits if bits else number
                for k in range(number):
                    if k % per == 0:
                        value = xxhash.xxh3_64_intdigest(term, seed=1 + 64 * bits + k // per) if bits else 0
                    if not value >> bits * (k % per) & (1 << bits) - 1:
                        found.append(first + k)
                first += number
            found = tuple(found)
            if len(self.known) < 500_000:
                self.known[term] = found
        return found

    def of(self, text: str) -> str:
        """SUBSETS hashes in hexadecimal, zeros for a subset without terms of the text.

        A text whose terms are all outside the band is taken by all its terms.
        """
        terms = terms_of(text)
        parts: list[list[str]] = [[] for _ in range(SUBSETS)]
        for term in sorted(terms & self.lexicon or terms):
            for s in self.subsets(term):
                parts[s].append(term)
        return "".join(f"{xxhash.xxh3_64_intdigest(' '.join(p)) | 1:016x}"[-DIGITS:] if p else EMPTY for p in parts)


_LAST: list[Fingerprinter] = []


def fingerprinter(lexicon: frozenset[str]) -> Fingerprinter:
    """The worker's fingerprinter of a lexicon, kept from task to task."""
    if not _LAST or _LAST[0].lexicon is not lexicon:
        _LAST[:] = [Fingerprinter(lexicon)]
    return _LAST[0]


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets that hold terms of either text; equal fingerprints have 1."""
    if a == b:
        return 1.0
    pairs = [(a[i : i + DIGITS], b[i : i + DIGITS]) for i in range(0, SUBSETS * DIGITS, DIGITS)]
    spoken = [x == y for x, y in pairs if x != EMPTY or y != EMPTY]
    return sum(spoken) / len(spoken)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, lexicon: frozenset[str], text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text (null: empty); one pass, no shuffle. Other columns are kept."""
    kept = [c for c in docs.columns if c != fingerprint]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by LOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fingerprinter(shared.value)
        for batch in batches:
            prints = pa.array([make.of(t or "") for t in batch.column(kept.index(text)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*kept, fingerprint])

    return source.mapInArrow(run, source.withColumn(fingerprint, F.lit("")).schema)


#: A place in the order of documents: whether the id is null, the id, the MD5 of the text (empty: before all of them).
Place = tuple[bool, int, bytes]


def _starts(docs: DataFrame, stretch: int) -> list[Place]:
    """The first place of each stretch of the order by id (null last), then by text.

    Ids are cut at quantiles. Rows that share one id, or have none, and are too many for a stretch are cut by the MD5
    of their texts; such a cut is the least digest that is there, so no stretch is empty. At most a few times
    MOST_STRETCHES places reach the driver.
    """
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    whole = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.min("doc_id").alias("least")).first()
    most = max(stretch, -(-whole["n"] // MOST_STRETCHES))
    # Null ids are always cut by their texts: nothing else orders them.
    heavy = counts.filter((F.col("rows") > most) | F.col("doc_id").isNull()).select("doc_id", F.ceil(F.col("rows") / most).alias("parts")).collect()
    known = {r.doc_id for r in heavy}
    places: set[Place] = set()
    if whole["least"] is not None:
        number = min(-(-whole["n"] // stretch), MOST_STRETCHES)
        shares = F.array(*[F.lit(i / number) for i in range(1, number)])
        cuts = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * number)))).first()[0] if number > 1 else []
        places = {(False, c, b"") for c in {*cuts, whole["least"]} - known}
    if heavy:
        parts = docs.sparkSession.createDataFrame([(r.doc_id, r.parts) for r in heavy], "heavy_id long, parts long")
        digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
        cut = docs.join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("heavy_id"))).select("doc_id", "parts", digest.alias("digest"))
        part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * F.col("parts") / F.lit(2.0**32))
        found = cut.groupBy("doc_id", part.alias("part")).agg(F.min("digest").alias("digest")).collect()
        places |= {(r.doc_id is None, r.doc_id or 0, bytes.fromhex(r.digest)) for r in found}
    return sorted(places)


OUT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_report(docs: DataFrame, low: float = LOW, high: float = HIGH, stretch: int = STRETCH) -> DataFrame:
    """Fingerprints of each document of ``doc_id, text``, of its edited text, and their likeness.

    The edited text takes its last half from the next document by ascending doc_id (after the last, the
    first; a single document follows itself). Null texts are empty; an empty text's fingerprint is all zeros
    and is like an empty one only. Rows that share an id follow each other in the order of their texts' MD5. Rows
    of null id come last, in that order. An empty table gives no rows. Extra columns are not read.

    Each text goes through one shuffle, compressed, to the stretch of the order that it is in; the first
    document of a stretch goes to the stretch before as well, which needs it as its last one's next. Rows that are equal
    in id and text stay in one stretch, which is read as a stream.
    """
    docs = docs.select("doc_id", "text")
    lexicon = docs.sparkSession.sparkContext.broadcast(lexicon_of(docs, low, high))
    starts = _starts(docs, stretch)
    numbers = max(1, len(starts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """stretch, late (a next document only), doc_id, digest (orders equal ids), packed text."""
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                packed, digest = pack.compress(raw), hashlib.md5(raw).digest()
                place = (doc_id is None, doc_id or 0, digest)
                at = bisect_right(starts, place) - 1
                rows.append((at, False, doc_id, digest, packed))
                if starts[at] in (place, (*place[:2], b"")):
                    rows.append(((at - 1) % numbers, True, doc_id, digest, packed))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["stretch", "late", "doc_id", "digest", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, unpack = fingerprinter(lexicon.value), zstandard.ZstdDecompressor()
        out: list[tuple] = []
        now, here, done = None, None, True
        for batch in batches:
            for stretch, late, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("stretch", "late", "doc_id", "packed"))):
                if stretch == now and late and done:
                    continue
                text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                there = (doc_id, text, make.of(text))
                if stretch == now and not done:
                    out.append(_row(make, *here, *there[1:]))
                now, here, done = stretch, there, late
                if len(out) >= 1000:
                    yield _rows(out)
                    out = []
        yield _rows(out)

    dealt = docs.mapInArrow(deal, "stretch int, late boolean, doc_id long, digest binary, packed binary")
    ordered = dealt.repartition(numbers, "stretch").sortWithinPartitions("stretch", "late", F.col("doc_id").asc_nulls_last(), "digest")
    return ordered.mapInArrow(read, OUT_SCHEMA)


def _row(make: Fingerprinter, doc_id: int | None, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    other = make.of(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, next_print)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split(" ")[0] for c in OUT_SCHEMA.split(", ")])
