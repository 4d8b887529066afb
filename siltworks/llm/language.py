"""Language identification as a mixture of languages.

Each language is a distribution over hashed character trigrams, counted over all its training documents. A
document is a bag of words; expectation-maximisation estimates which share of its words each language wrote. The
languages of a document are the nested set, by share, with the best likelihood less a penalty per language.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.bpe import BoundedCache

#: Trigrams are hashed to this many buckets, so a model has at most BUCKETS numbers per language.
BUCKETS = 1 << 16
SMOOTHING = 0.5
ITERATIONS = 8
#: Penalty of one more language of the set, in nats beside half the log of the words.
PENALTY = 3.0
#: Runs of letters; longer ones are cut, so that text without blanks has words too.
WORD = re.compile(r"[^\W\d_]{1,16}")
UNKNOWN = "und"


def trigrams(word: str) -> np.ndarray:
    """Buckets of the trigrams of a word between marks of its ends."""
    marked = f"\x02{word}\x03"
    return np.array([zlib.crc32(marked[i : i + 3].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(marked) - 2)], np.int64)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in the sense of Unicode; numerals such as a half or a Roman seven are none."""
    found = WORD.findall((text or "").lower())
    if (text or "").isascii() or "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_rates: np.ndarray  # BUCKETS x languages, float32


def _counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all documents; a task holds one array per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        counts: dict[str, np.ndarray] = {}

        def settle(lang: str) -> None:
            into = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for w, n in words.pop(lang).items():
                np.add.at(into, trigrams(w), n)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found = words.setdefault(lang, Counter())
                found.update(words_of(text.as_py()))
                if len(found) > 100_000:
                    settle(lang)
        for lang in list(words):
            settle(lang)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, usable: Column) -> LanguageModel:
    """Learn from all rows of ``lang, text`` that ``usable`` admits and whose lang and text are not null.

    The driver gets at most BUCKETS numbers per language, whatever the size of the corpus.
    """
    rows = _counts(docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())).toArrow()
    langs, at, n = rows.column("lang").to_pylist(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    languages = tuple(sorted(set(langs)))
    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[at, [number[x] for x in langs]] += n
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


class Identifier:
    def __init__(self, model: LanguageModel):
        self.model, self.size = model, len(model.languages)
        self.words = BoundedCache(lambda w: model.log_rates[trigrams(w)].sum(axis=0, dtype=np.float32).tobytes(), 30_000_000 // (100 + 4 * self.size))

    def _shares(self, likely: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        """Shares of the columns of ``likely`` (words x languages) and the mean log likelihood, by EM."""
        share = np.full(likely.shape[1], 1 / likely.shape[1])
        for _ in range(steps):
            joint = likely @ share
            share = share * (likely.T @ (1 / joint)) / len(likely)
        return share, float(np.log(likely @ share).mean())

    def mixture(self, words: list[str]) -> dict[str, float]:
        """Share of each language of the document's set; empty without words."""
        if not words or not self.size:
            return {}
        logs = np.frombuffer(b"".join(self.words.all(words)), np.float32).reshape(-1, self.size).astype(np.float64)
        top = logs.max(axis=1, keepdims=True)
        likely = np.exp(np.maximum(logs - top, -50))
        share, mean = self._shares(likely, ITERATIONS)
        # No mixture of the languages is likelier: the logarithm of a mean bounds the mean of logarithms.
        most = len(words) * (mean + math.log(max(1.0, float((likely.T @ (1 / (likely @ share))).max()) / len(words))))
        order = np.argsort(-share, kind="stable").tolist()
        best, chosen = -math.inf, {}
        for k in range(1, len(order) + 1):
            if k > 1 and most - (k - 1) * (PENALTY + 0.5 * math.log(len(words))) <= best:
                break
            part, mean = self._shares(likely[:, order[:k]], 1 if k == 1 else ITERATIONS)
            value = mean * len(words) - (k - 1) * (PENALTY + 0.5 * math.log(len(words)))
            if value <= best:
                break
            best, chosen = value, {self.model.languages[i]: float(p) for i, p in zip(order, part)}
        return chosen

    def best(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """The language of the largest share, that share drawn towards even shares in short texts, and the set."""
        words = words_of(text)
        found = self.mixture(words)
        if not found:
            return UNKNOWN, 0.0, found
        lang = max(found, key=lambda x: (found[x], x))
        return lang, (found[lang] * len(words) + 0.5) / (len(words) + 0.5 * max(2, self.size)), found


_LAST: list[Identifier] = []


def identifier(model: LanguageModel) -> Identifier:
    """The worker's identifier of a model, kept from task to task."""
    if not _LAST or _LAST[0].model is not model:
        _LAST[:] = [Identifier(model)]
    return _LAST[0]


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred, score and languages (a map of the set's shares) to each row; one pass, no shuffle.

    Null texts and texts without a letter are ``und`` with score 0 and an empty map, and so is every text if no
    language was learned. Whole texts count. Equal texts have equal results, in repeated rows too; of languages of
    equal shares the one of the greater name is ``lang_pred``. Columns of the input are kept, whatever their
    names; ones with the new names are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "languages": F.lit(None).cast("map<string,double>")}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = identifier(shared.value)
        BoundedCache.claim(identify.words)
        for batch in batches:
            found = [identify.best(t) for t in batch.column(kept.index(text)).to_pylist()]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*kept, "lang_pred", "score", "languages"])

    return source.mapInArrow(run, schema)
