import itertools
import random

import numpy as np
import pandas as pd
import pytest

from siltworks.llm import embeddings, minhash
from siltworks.llm.components import connected_components


def closure(ids, links):
    least = {i: i for i in ids}
    while True:
        new = dict(least)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == least:
            return least
        least = new


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, closure(sets, links)


def check(df, rows, size=2, percent=80):
    counts, least = brute(rows, size, percent)
    out = {r.doc_id: r for r in minhash.near_duplicates(df, size, percent).collect() if r.doc_id is not None}
    assert {i: r.n_shingles for i, r in out.items()} == counts
    assert {i: r.component_id for i, r in out.items()} == least
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.values())


@pytest.mark.parametrize("size", [2, 5])
def test_documents(documents, size):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()], size)


def edited_copies(n, seed, words=80, most=0.25):
    """Copies of one text with up to ``most`` of the words changed: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for i in range(n):
        share = rng.random() * most
        out.append((i, " ".join(w if rng.random() > share else f"e{rng.randrange(10_000)}" for w in base)))
    return out


def test_many_near_copies_around_the_threshold(spark, monkeypatch):
    rows = edited_copies(150, 1) + [(1000 + i, t) for i, t in edited_copies(60, 2, words=9)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_smaller_than_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = edited_copies(120, 3)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_blocks_of_long_documents(spark, monkeypatch):
    """Blocks bounded by shingles, and no sketch test at all."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    monkeypatch.setattr(minhash, "CELL_SHINGLES", 1000)
    rows = edited_copies(90, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    counts, least = brute(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2, 80, margin=float("inf")).collect()} == least


def test_recall_of_near_copies_at_table_size(documents):
    """Of copies with one changed word in ten, all whose sets reach the threshold are linked to their source."""
    rng = random.Random(13)
    rows = [(r.doc_id, r.text) for r in documents.limit(400).collect() if r.text and 20 <= len(r.text.split()) <= 400]
    near = []
    for i, text in rows:
        words = text.split(" ")
        near.append((10_000_000 + i, " ".join(w if rng.random() > 0.08 else f"q{rng.randrange(99)}" for w in words)))
    check(documents.sparkSession.createDataFrame(rows + near, "doc_id long, text string"), rows + near)


def test_chain_of_links(spark):
    words = [f"v{i}" for i in range(140)]
    rows = [(i, " ".join(words[i : i + 60])) for i in range(80)]
    assert set(brute(rows, 2, 80)[1].values()) == {0}
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_odd_rows(odd):
    out = minhash.near_duplicates(odd, 2, 80).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == odd.count()
    assert by_id[2].component_id == 1 and not by_id[2].kept
    for i in (3, 4, 6):
        assert (by_id[i].n_shingles, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[8].n_shingles == 1
    assert (by_id[None].component_id, by_id[None].kept, by_id[None].n_shingles) == (None, True, 4)


def test_id_that_leads_two_sets(spark):
    # The two texts of id 5 come in either order, so that neither can be kept by luck.
    for flip in (1, -1):
        t1, t2 = [" ".join(f"{c}{i}" for i in range(60)) for c in "pq"][::flip]
        near1, near2 = (f"{t} more" for t in (t1, t2))
        rows = [(5, t1), (5, t2), (7, t2), (8, t1), (9, near2), (10, near1)]
        for some in (rows, rows[::-1]):
            out = minhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"), 2, 80).collect()
            assert len(out) == 6 and {r.component_id for r in out} == {5}


def test_no_rows(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


def test_estimates_are_near():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        common, a, b = (np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in (4000 * share, 2000 * (1 - share), 2000 * (1 - share)))
        x, y = (minhash.sketch(np.union1d(common, z)) for z in (a, b))
        estimate, either = minhash.estimated_jaccard(x, y)
        assert abs(estimate - share) < 5 * np.sqrt(share * (1 - share) / either) + 0.01


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(500 + i, 501 + i) for i in range(70)] + [(7, 900 + i) for i in range(50)]
    ids = {x for e in edges if e[0] != e[1] for x in e}
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: c for i, c in closure(ids, [e for e in edges if e[0] != e[1]]).items()}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_vectors(rows, threshold):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v is not None and None not in v and len(v) == 16 and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if unit[a] @ unit[b] >= threshold]
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, closure([i for i, _ in rows], links)


@pytest.mark.parametrize("block", [512, 20])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(150)]
    center = rng.standard_normal(16)
    rows += [(200 + i, (center + 0.12 * rng.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(400, rows[0][1]), (401, [2 * x for x in rows[0][1]]), (402, None), (403, [0.0] * 16), (404, [None, *[1.0] * 15]), (405, [float("nan"), *[1.0] * 15]), (406, [1.0] * 7), (407, [float("inf"), *[1.0] * 15])]
    count, least = brute_vectors(rows, 0.95)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embeddings.near_embeddings(df, miss=1e-9).collect()}
    assert {i: r.n_links for i, r in out.items()} == count
    assert {i: r.component_id for i, r in out.items()} == least


def test_vectors_of_several_lengths_and_ids_of_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 1.0, 0.01]), (5, [1.0] * 4)]
    # Id 10 leads two classes; only the second is near 12.
    rows += [(10, [0.0, 0.0, -1.0]), (10, [-1.0, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (12, [-1.0, 0.01, 0.0]), (13, [0.0, 0.01, -1.0])]
    out = {r.vec_id: r for r in embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-9).collect()}
    assert {i: r.n_links for i, r in out.items() if i != 10} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 11: 2, 12: 2, 13: 1}
    assert {i: r.component_id for i, r in out.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 10: 10, 11: 10, 12: 10, 13: 10}


def test_tables_of_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    m = np.stack([v / np.linalg.norm(v) for _, v in rows])
    links = (m @ m.T >= 0.95).sum(axis=1) - 1
    out = {r.vec_id: r.n_links for r in embeddings.near_embeddings(df).collect()}
    assert [out[i] for i, _ in rows] == links.tolist()


def test_vectors_odd(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_embeddings(empty).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<float>").selectExpr("*", "'x' as n_links", "1 as kept")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_embeddings(df).collect()), key=str)
    assert out == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_tables_follow_the_threshold():
    for n in (1000, 10**6, 10**10):
        bits, tables = embeddings.plan_tables(n, 0.95)
        meet = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - meet) ** tables <= embeddings.MISS


def planted_vectors(n, dim, pairs, seed):
    """Random vectors, and partners of some of them at cosines from 0.95 up, many of them close to it."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    extra = []
    for i in range(pairs):
        side = rng.standard_normal(dim)
        side -= side @ base[i] * base[i]
        side /= np.linalg.norm(side)
        cosine = 0.9501 + 0.0499 * rng.random() ** 3
        extra.append((cosine * base[i] + np.sqrt(1 - cosine**2) * side) * rng.uniform(0.1, 10))
    return np.vstack([base, extra])


def test_recall_of_planted_pairs_at_the_defaults(spark):
    vectors = planted_vectors(6000, 24, 1500, 12)
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    links = {i: set() for i in range(len(units))}
    for at in range(0, len(units), 500):
        for i, j in zip(*np.nonzero(units[at : at + 500] @ units.T >= 0.95)):
            if i + at != j:
                links[i + at].add(int(j))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    wanted, found = sum(map(len, links.values())), sum(r.n_links for r in out.values())
    assert wanted >= 3000 and all(out[i].n_links <= len(links[i]) for i in links)
    assert found >= 0.99 * wanted
    least = closure(range(len(units)), [(i, j) for i in links for j in links[i]])
    assert sum(out[i].component_id == least[i] for i in links) >= 0.99 * len(links)


def test_signs_never_part_a_near_pair(spark):
    """Pairs exactly at the threshold differ in fewer signs than the bound lets through."""
    rng = np.random.default_rng(2)
    a, side = rng.standard_normal((2, 20_000, 16))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    planes = rng.standard_normal((16, embeddings.SIGNS))
    differ = ((a @ planes > 0) != (b @ planes > 0)).sum(axis=1)
    assert differ.max() <= embeddings.most_differing(embeddings.SIGNS, 0.95) < 0.3 * embeddings.SIGNS


def test_a_hot_bucket_of_near_vectors(spark, monkeypatch):
    """A third of all rows are distinct vectors near each other: more than one block, every link counted once."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(7)
    center = rng.standard_normal(20)
    hot = center + 0.02 * rng.standard_normal((300, 20))
    vectors = np.vstack([rng.standard_normal((600, 20)), hot])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    assert all(out[i].n_links == 299 and out[i].component_id == 600 for i in range(600, 900))
    assert all(out[i].n_links == 0 and out[i].kept for i in range(600))


def test_a_pair_is_sent_out_by_its_first_table_alone():
    """Of a close group most vectors are promising in the first table, few in later ones: those with a partner not met before."""
    rng = np.random.default_rng(5)
    bits, tables, dim = 8, 12, 24
    vectors = rng.standard_normal(dim) + 0.02 * rng.standard_normal((80, dim))
    signs = vectors @ embeddings.directions(dim, bits, tables, 0) > 0
    codes = signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))
    packed = [x.tobytes() for x in np.packbits(signs[:, : embeddings.SIGNS], axis=1)]
    sent = []
    for table in range(tables):
        pdf = pd.DataFrame({"vec_id": range(80), "dim": dim, "bucket_table": table, "bucket": codes[:, table], "block": 0, "lo": 0, "hi": 0, "cell": 0, "signs": packed})
        out = embeddings._promising(embeddings.SIGNS, bits)(pdf)
        together = codes[:, None, table] == codes[None, :, table]
        before = (codes[:, None, :table] == codes[None, :, :table]).any(axis=2)
        want = (together & ~before & ~np.eye(80, dtype=bool)).any(axis=1)
        assert sorted(out["vec_id"]) == np.flatnonzero(want).tolist()
        sent.append(len(out))
    assert sent[0] > 40 and sum(sent[1:]) < 2 * sent[0]
