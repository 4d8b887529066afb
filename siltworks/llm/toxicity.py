"""Toxicity by compression distance.

Two zstandard dictionaries share one base of ordinary text, followed by as much text that marks toxic documents in
one and ordinary ones in the other. A window is one word between two stretches of the base. A window that the
toxic dictionary knows as a whole, and that it shortens by enough bytes more than the ordinary one, tells of toxic
text. How many bytes are enough is calibrated on the labelled documents, and a logistic model calibrates how many
such windows make a document toxic.

This departs from dictionaries trained on all text of each class, as about one word in a hundred of a toxic
document is toxic (README has the figures). The marking text consists of words, chosen on labelled documents by an
exact test at a rate of false discoveries; all documents count, except near copies, so that copies of one document
do not bring their ordinary words in.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.bpe import BoundedCache

#: Bounds of the labelled sample that a model is fitted on: rows, and characters of all their texts.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 40_000_000
#: Bytes of the shared base, and of the base around a window.
BASE_BYTES, AROUND = 16 * 1024, 120
#: Words of a stretch of text, and stretches that the base is trained on: evenly spread over all ordinary text.
STRETCH_WORDS, STRETCHES = 32, 50_000
LEVEL = 15
#: Of the words of the toxic dictionary, the share that may be there by chance, and how many times as frequent
#: among toxic documents as among others each must be.
FALSE, TIMES = 0.1, 10.0
#: Bytes of the base that a dictionary holds on either side of a marking word.
FRAME = 16
#: Marks of a word's ends, so that an end of a word in the dictionary costs a match of its own.
OPEN, CLOSE = b"\x02\x03\x02 ", b" \x03\x02\x03"
#: Words whose gain a Python worker remembers, and the driver while it fits.
GAINS, FIT_GAINS = 250_000, 100_000
#: Gains from which a known window may tell; the one of the best likelihood is taken.
CUTS = range(2, 10)
#: Numbers that describe a text to the calibration.
FEATURES = 6


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs; a few ten kilobytes whatever the corpus."""

    ordinary: bytes
    toxic: bytes
    around: bytes
    #: Bytes of a window that the toxic dictionary knows as a whole, and gain from which such a window tells.
    known: int
    cut: int
    weights: tuple[float, ...]


#: Marks that may stand around a word; they are not part of it.
MARKS = ".,;:!?\"'()[]{}<>*#&%$@~^_=+|/\\-"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare_words(text: str | None) -> set[str]:
    return {w.strip(MARKS) for w in words_of(text)} - {""}


def without_copies(docs: list[str | None]) -> list[str | None]:
    """Of documents that share a min-hash of their five-word shingles, the first.

    Near copies of one toxic document would bring its ordinary words in.
    """
    seen, kept = set(), []
    for d in docs:
        words = words_of(d)
        shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
        keys = {(k, min(xxhash.xxh3_64_intdigest(x, seed=k) for x in shingles)) for k in range(4)}
        if not keys & seen:
            kept.append(d)
        seen |= keys
    return kept


def chance(a: int, both: int, mine: int, rows: int) -> float:
    """Probability that of ``both`` documents with a word, ``a`` or more fall among ``mine`` of ``rows`` (Fisher's test)."""

    def ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    every = ways(rows, both)
    return math.fsum(math.exp(ways(mine, k) + ways(rows - mine, both - k) - every) for k in range(max(a, both - rows + mine), min(both, mine) + 1))


def marking_text(docs: list[str | None], other: list[str | None]) -> list[str]:
    """Words that mark ``docs`` against ``other``, those of the highest odds last. Texts are read one by one.

    All words are tried, however rare; of those chosen a share of FALSE is expected to be there by chance
    (Benjamini and Hochberg).
    """
    if not docs or not other:
        return []
    docs, mine, theirs = without_copies(docs), Counter(), Counter()
    for d in docs:
        mine.update(bare_words(d))
    for d in other:
        theirs.update(w for w in bare_words(d) if w in mine)
    rows, seen = len(docs) + len(other), {}
    tried = []
    for w, n in mine.items():
        pair = (n, theirs[w])
        if pair not in seen:
            seen[pair] = chance(n, n + theirs[w], len(docs), rows)
        tried.append((seen[pair], w))
    tried.sort()
    number = max((k for k, (p, _) in enumerate(tried, 1) if p <= FALSE * k / len(tried)), default=0)
    odds = lambda w: (mine[w] + 0.5) / (len(docs) + 1) * (len(other) + 1) / (theirs[w] + 0.5)
    return sorted((w for _, w in tried[:number] if odds(w) >= TIMES), key=lambda w: (odds(w), w))


def _spelled(marks: list[str], around: bytes, typical: list[str]) -> tuple[bytes, bytes]:
    """Each word as its window has it, between ends of the base; and an ordinary counterpart.

    A word that marks is one match with the base around it, one that only begins alike is not. The counterpart has
    letters of typical words in its place, so that the base around a window finds the same matches in both.
    """
    filler = cycle(" ".join(typical) + " ") if typical else cycle(" ")
    mine, theirs = [], []
    for mark in marks:
        for out, word in ((mine, mark), (theirs, "".join(islice(filler, len(mark))))):
            out.append(around[-FRAME:] + OPEN + word.encode("utf-8", "surrogatepass") + CLOSE + around[:FRAME])
    return b"".join(mine), b"".join(theirs)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    options = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=options)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=options)


class Scorer:
    def __init__(self, model: ToxicityModel, remembered: int = GAINS):
        self.model = model
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)
        self.gains = BoundedCache(self.gain, remembered)

    def window(self, word: str) -> bytes:
        return self.model.around + OPEN + word.encode("utf-8", "surrogatepass") + CLOSE + self.model.around

    def gain(self, word: str) -> int:
        """Bytes by which the toxic dictionary shortens the window of a word that it knows; 0 for other words."""
        window = self.window(word.strip(MARKS))
        mine = len(self.toxic.compress(window))
        return max(0, len(self.ordinary.compress(window)) - mine) if mine <= self.model.known else 0

    def telling(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Gains of the text's distinct words that have one, gains of all those words, and the number of all words."""
        words = words_of(text)
        found = [(w.strip(MARKS), g) for w, g in zip(words, self.gains.all(words)) if g]
        return list(dict(found).values()), [g for _, g in found], len(words)

    def score(self, text: str | None) -> float:
        z = float(np.dot(features(*self.telling(text), self.model.cut), self.model.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(distinct: list[int], every: list[int], words: int, cut: int) -> list[float]:
    """What the calibration sees of a text: one, two, and more distinct telling words, all of them, and the length."""
    k = sum(g >= cut for g in distinct)
    return [1.0, float(k > 0), float(k > 1), float(min(max(k - 2, 0), 2)), math.log1p(sum(g >= cut for g in every)), math.log1p(words)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps; the ridge leaves the constant alone."""
    w, pull = np.zeros(x.shape[1]), ridge * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6), x.T @ (p - y) + pull * w)
    return w


def _base(docs: list[str | None]) -> bytes:
    """The base, trained on stretches spread evenly over all text of ``docs``."""
    every = max(1, -(-sum(len(words_of(d)) // STRETCH_WORDS + 1 for d in docs) // STRETCHES))
    sample, turn = [], 0
    for d in docs:
        words = words_of(d)
        for at in range(0, len(words), STRETCH_WORDS):
            if turn % every == 0:
                sample.append(" ".join(words[at : at + STRETCH_WORDS]).encode("utf-8", "surrogatepass"))
            turn += 1
    try:
        return zstandard.train_dictionary(BASE_BYTES, sample).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(sample)[-BASE_BYTES:]


def fit(rows: list[tuple[str | None, int]]) -> ToxicityModel:
    """A model of (text, label) rows. With one label alone, all scores are that label's smoothed rate."""
    groups: tuple[list[str | None], list[str | None]] = ([], [])
    for text, label in rows:
        groups[label].append(text)
    marks = marking_text(groups[1], groups[0])
    base, known = _base(groups[0]), set(marks)
    frequent = Counter(w for text in groups[0] for w in bare_words(text))
    typical = [w for w, _ in sorted(frequent.items(), key=lambda p: (-p[1], p[0]))[:5000] if w not in known]
    pad = max(0, 2 * AROUND - len(base)) * b"#"
    base = pad + base
    toxic, ordinary = _spelled(marks, base[-AROUND:], typical)
    model = ToxicityModel(base + ordinary, base + toxic, base[-AROUND:], 0, 1, (0.0,) * FEATURES)
    lengths = sorted(len(s.toxic.compress(s.window(w))) for s in [Scorer(model, 1)] for w in marks)
    model = replace(model, known=lengths[len(lengths) // 2] if lengths else 0)
    if not (groups[0] and groups[1]):
        rate = (len(groups[1]) + 0.5) / (len(rows) + 1)
        return replace(model, weights=(math.log(rate / (1 - rate)),) + (0.0,) * (FEATURES - 1))
    scorer, y = Scorer(model, FIT_GAINS), np.array([label for _, label in rows], float)
    seen = [scorer.telling(text) for text, _ in rows]
    best = None
    for cut in CUTS:
        x = np.array([features(*s, cut) for s in seen])
        weights = _logistic(x, y)
        z = np.clip(x @ weights, -30, 30)
        loss = float((np.logaddexp(0, z) - y * z).sum())
        if best is None or loss < best[0]:
            best = (loss, cut, tuple(map(float, weights)))
    return replace(model, cut=best[1], weights=best[2])


def fit_table(docs: DataFrame, labels: DataFrame, usable: Column, max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> ToxicityModel:
    """Fit on documents ``doc_id, text`` whose labels ``doc_id, toxic`` are 0 or 1 and that ``usable`` admits.

    At most ``max_rows`` rows in the order of a hash of doc_id, as far as their texts hold ``max_chars``.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(usable).withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(max_rows)
    # At most max_rows ids are broadcast, so the texts of all documents need no shuffle. Of rows that repeat an id the
    # least text counts, found with partial results.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic", "turn").agg(F.min("text").alias("text"))
    rows = rows.withColumn("chars", F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.orderBy("turn", "doc_id")))
    rows = rows.filter(F.col("chars") <= max_chars)
    return fit([(r.text, r.toxic) for r in rows.orderBy("turn", "doc_id").select("text", "toxic").collect()])


@lru_cache(maxsize=1)
def scorer(model: ToxicityModel) -> Scorer:
    return Scorer(model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add ``score``, the probability of label 1, to each row; one pass, no shuffle.

    Null and empty texts score as texts without words. Whole texts count, however long. All columns are kept; one
    already named like the score is replaced. Equal texts have equal scores, in repeated rows too, and ids play no
    part. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c != score]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(model).score
        BoundedCache.claim(scorer(model).gains)
        for batch in batches:
            scores = pa.array([rate(t.as_py()) for t in batch.column(kept.index(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*kept, score])

    return source.mapInArrow(run, source.withColumn(score, F.lit(0.0)).schema)
