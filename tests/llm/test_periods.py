import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm.periods import find_runs, lag_matches, run_report, runs_of


def brute(w, min_length=6, min_periods=4):
    """All runs, by extending each lag's equal words from each place."""
    n, out = len(w), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_periods * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_with_runs(rng, n, letters):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        else:
            word = [rng.randrange(letters) for _ in range(rng.randrange(1, max(2, n // 6)))]
            out += (word * rng.randrange(2, 12))[: rng.randrange(1, n)]
    return out[:n]


@pytest.mark.parametrize("block", [16, 40, 1024])
def test_runs_against_brute_force(block):
    rng = random.Random(block)
    for _ in range(150):
        w = text_with_runs(rng, rng.randrange(0, 260), rng.choice([1, 2, 3, 8, 100]))
        assert runs_of(np.array(w, np.int32), block=block, frequent=rng.choice([1, 2, 5, 16])) == brute(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(2, 5), st.integers(1, 9))
def test_other_bounds(w, min_periods, min_length):
    assert runs_of(np.array(w, np.int32), min_length, min_periods, block=16, frequent=2) == brute(w, min_length, min_periods)


def test_lag_matches_are_exact():
    rng = np.random.default_rng(3)
    for frequent in (1, 3, 50):
        ids = np.minimum(rng.geometric(0.05, 700), 40).astype(np.int32)
        counts = lag_matches(ids, 300, frequent)
        assert [int(c) for c in counts[1:]] == [int((ids[:-q] == ids[q:]).sum()) for q in range(1, 301)]


def test_very_long_texts():
    """One word over and over, a long period, and no run at all: half a million words each, in seconds."""
    rng = np.random.default_rng(4)
    started = time.time()
    assert runs_of(np.zeros(500_000, np.int32)) == [(0, 500_000, 1)]
    word = rng.integers(0, 50_000, 90_001).astype(np.int32)
    assert runs_of(np.tile(word, 6)[:500_000]) == [(0, 500_000, 90_001)]
    assert runs_of(np.minimum(rng.zipf(1.3, 300_000), 50_000).astype(np.int32) + np.arange(300_000, dtype=np.int32) % 2 * 100_000) is not None
    assert time.time() - started < 60


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    w = words(text)
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_report_against_brute_force(spark, documents):
    from siltworks.llm.queries import ship

    ship(spark)
    short = documents.filter("length(text) < 6000")
    assert short.count() > 100
    assert rows(run_report(short)) == sorted((expected(r.doc_id, r.text) for r in short.collect()), key=str)


def test_report_on_made_texts(spark):
    from siltworks.llm.queries import ship

    ship(spark)
    rng = random.Random(9)
    texts = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(f"w{x}é" for x in text_with_runs(rng, rng.randrange(200), 4))) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(run_report(df)) == sorted((expected(*t) for t in texts), key=str)


def test_odd_rows(spark, odd, nothing):
    from siltworks.llm.queries import ship

    ship(spark)
    odd = odd.unionByName(odd.limit(1).selectExpr("doc_id", "repeat('a b ', 10) as text", "lang", "source", "extra", "n_shingles", "size", "sketch", "score"))
    assert rows(run_report(odd.filter("length(text) < 5000 or text is null"))) == sorted((expected(r.doc_id, r.text) for r in odd.filter("length(text) < 5000 or text is null").collect()), key=str)
    assert run_report(odd).count() == odd.count() and run_report(nothing).count() == 0
    found = find_runs(odd.selectExpr("text as `te``xt.x`", "extra as Runs", "extra as `COLLAPSED`", "doc_id as words"), "te`xt.x")
    assert found.columns == ["te`xt.x", "words", "runs", "collapsed"]
    repeated = {tuple(map(tuple, x.runs)): x.collapsed for x in found.filter("size(runs) > 0").collect()}
    assert repeated == {((0, 20, 2),): "a b", ((0, 30_000, 997),): " ".join(f"word{i}" for i in range(997))}
