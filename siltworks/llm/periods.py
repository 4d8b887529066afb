"""Periodic runs of words, found by counting matches at each lag before any place is looked at.

A run is a stretch of words with smallest period q that repeats at least ``min_periods`` times, has at least
``min_length`` words, and that no neighbour extends. At lag q it has a match, two equal words q apart, at each of its
places but the last q. So only lags with that many matches can have one.

Matches are counted exactly by word: those of frequent words at all lags at once, as the autocorrelation of their
places by fast Fourier transform, those of rare words by the differences of all their pairs. They are counted within
windows that overlap by half and are eight times the longest lag or more, which double for longer lags: a run repeats
often enough in some window, while the matches that any text has by chance stay few against a long lag. Matches inside
runs known already, at multiples of their period, belong to no other run and are taken off. A lag with enough left has its
islands, the stretches of matches, scanned over the whole text, once. Work grows with n log^2 n but for texts of runs of
very many periods, memory with n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.common import WORD_PATTERN, add_columns

MIN_LENGTH, MIN_PERIODS = 6, 4
#: Words of the smallest windows, and a word's places from which it counts as frequent there; both for windows at larger lags grow.
BLOCK, FREQUENT = 1024, 16
#: Bytes of the transforms that are made together.
TRANSFORM_BYTES = 1 << 25

Run = tuple[int, int, int]
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lag_matches(ids: np.ndarray, most: int, frequent: int = FREQUENT) -> np.ndarray:
    """For each lag up to ``most`` the places i with equal ids at i and i + lag; entry 0 is of no use."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ordered = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(first, n))
    counts = np.zeros(most + 1, np.int64)

    # Pairs of rare words: each place and the j-th next one of its word.
    places = order[np.repeat((sizes > 1) & (sizes <= frequent), sizes)]
    words = ids[places]
    for j in range(1, len(places)):
        same = words[j:] == words[:-j]
        if not same.any():
            break
        gaps = (places[j:] - places[:-j])[same]
        counts += np.bincount(gaps[gaps <= most], minlength=most + 1)

    heavy = np.flatnonzero(sizes > frequent)
    if len(heavy):
        size = 1 << int(n + most - 1).bit_length()
        power, at_once = np.zeros(size // 2 + 1), max(1, TRANSFORM_BYTES // (8 * size))
        for a in range(0, len(heavy), at_once):
            some = heavy[a : a + at_once]
            marks = np.zeros((len(some), size))
            for row, w in enumerate(some):
                marks[row, order[first[w] : first[w] + sizes[w]]] = 1
            found = np.fft.rfft(marks)
            power += (found.real**2 + found.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts


def _primitive(word: np.ndarray) -> bool:
    """Whether a word is no repetition of a shorter one."""
    n = rest = len(word)
    p = 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if (word[: -(n // p)] == word[n // p :]).all():
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _islands(ids: np.ndarray, lag: int, least: int) -> Iterator[Run]:
    """The runs of period ``lag``: stretches of at least so many matches whose smallest period it is."""
    edges = np.flatnonzero(np.diff((ids[:-lag] == ids[lag:]).astype(np.int8), prepend=0, append=0))
    starts, matches = edges[::2], edges[1::2] - edges[::2]
    for i in np.flatnonzero(matches >= least):
        start = int(starts[i])
        if _primitive(ids[start : start + lag]):
            yield start, int(matches[i]) + lag, lag


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, block: int = BLOCK, frequent: int = FREQUENT) -> list[Run]:
    """All runs (start, length, period) of a sequence, by start, then period.

    ``min_periods`` is 2 at least. A window holds 2 * ``min_periods`` times its longest lag, and ``min_length`` words twice.
    """
    n, known, scanned = len(ids), [], set()
    size = max(block, 2 * min_length, 2 * min_periods)
    low, last = 1, n // min_periods
    need = np.maximum(min_length, min_periods * np.arange(last + 1)) - np.arange(last + 1)
    while low <= last and n >= min_length:
        high = last if size >= n else min(last, size // (2 * min_periods))
        for a in range(0, 1 if size >= n else n, size // 2):
            b = min(n, a + size)
            most = min(high, (b - a) // min_periods)
            if most < low:
                break
            matches = lag_matches(ids[a:b], most, int(frequent * (size / block) ** 0.5))

            def explain(run: Run, matches: np.ndarray = matches, a: int = a, b: int = b) -> None:
                start, length, period = run
                inside = min(b, start + length) - max(a, start)
                own = matches[2 * period : max(inside, 0) : period]
                own -= inside - period * np.arange(2, 2 + len(own))

            for run in known:
                explain(run)
            for lag in range(low, most + 1) if most - low < 8 else low + np.flatnonzero(matches[low:] >= need[low : most + 1]):
                lag = int(lag)
                if matches[lag] >= need[lag] and lag not in scanned:
                    scanned.add(lag)
                    for run in _islands(ids, lag, int(need[lag])):
                        known.append(run)
                        explain(run)
            if b == n:
                break
        low, size = high + 1, 2 * size
    return sorted(known, key=lambda r: (r[0], r[2]))


def word_ids(words: list[bytes]) -> np.ndarray:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add the periodic runs of each text, and the text without their repetitions; one pass, no shuffle.

    ``runs`` are (start, length, period) in words, by start, then period. ``collapsed`` joins by one blank the words
    that no run contains beyond its first period. A null or empty text, or one of white space, has no runs and
    an empty collapsed text. Whole texts of any length are taken; a text is one row and so one task's. Rows are independent:
    repeated rows and ids need no rule, and an empty table gives no rows. Columns of the input are kept whatever their
    names; ones called like an output, in any case, are replaced.
    """

    def compute(batches: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for texts in batches:
            found, rest = [], []
            for value in texts.cast(pa.large_binary()):
                # Of bytes, split() takes the same six characters as white space.
                words = (value.as_py() or b"").split()
                all_runs = runs_of(word_ids(words), min_length, min_periods)
                if all_runs:
                    stays = np.ones(len(words), bool)
                    for start, length, period in all_runs:
                        stays[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                found.append([dict(zip(("start", "length", "period"), r)) for r in all_runs])
                rest.append(b" ".join(words))
            yield [pa.array(found, _RUNS_ARROW), pa.array(rest, pa.large_binary()).cast(pa.string())]

    return add_columns(docs, text, {runs: RUNS, collapsed: T.StringType()}, compute)


def _with_repetitions(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the texts of a tenth of the ids, by crc32, repeat a stretch to their end.

    With h the crc32 and g = floor(h / 10), the words from a = g % n on become those of the p words there, over and over.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    df = docs.select("doc_id", "text", h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    df = df.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("words"))
    df = df.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    df = df.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> if(i < a, words[i], words[a + (i - a) % p])), ' ')")
    return df.select("doc_id", F.when(F.col("n").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one (ties: smallest start, then period) and digests, of texts made periodic by id.

    The rules of ``find_runs`` hold; a text of a row without an id is taken as it is. Without a run the longest one's
    columns are null. Extra columns are not read.
    """
    found = find_runs(_with_repetitions(docs))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.length"), F.col("best.period")
    milli = F.floor(length * 1000 / period).cast("long")
    return found.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
