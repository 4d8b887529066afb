import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.llm import bpe, fingerprints, language, lines, packing, toxicity
from tests.oracle import duck, same_rows

HARD = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "日本語 テキスト 🙂🙂 abc\u0085x  y  ", "a" * 3000, "\x1c\x1d x\x1f\x1fy", "it's I'LL 'RE we've'' 12½³ x", "naïve ﬁ ​ z", "\r\n\r\n  a", " " * 500, "ab" * 2000, "Ωmega Ж 中", "é́"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_file("byte_bpe_50k.json"))


# Token counts


def test_counts_equal_the_library(documents):
    texts = [r.text for r in documents.collect()] + HARD
    own, t = bpe.counter(bpe.tokenizer_file("byte_bpe_50k.json")), library()
    assert [own.count(x) for x in texts] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_report(odd, nothing):
    t = library()
    out = bpe.token_report(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(out) == odd.count()
    for r in out:
        text = texts[r.doc_id] or ""
        assert r.n_bytes == len(text.encode()) and r.n_tokens == len(t.encode(text, add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 512)
    assert bpe.token_report(nothing).collect() == []
    kept = bpe.count_tokens(odd.withColumn("n_tokens", F.lit("clash")))
    assert kept.columns.count("n_tokens") == 1 and dict(kept.dtypes)["n_tokens"] == "bigint" and "extra" in kept.columns


def test_merging_works_on_one_symbol_and_none():
    own = bpe.counter(bpe.tokenizer_file("byte_bpe_50k.json"))
    assert own.tokens_of("") == 0 and own.tokens_of("a") == 1


def test_cache_stays_bounded():
    cache = bpe.BoundedCache(len, entries=10)
    assert cache.all([f"{i}" for i in range(50)]) == [len(f"{i}") for i in range(50)]
    cache.all(["one", "two"])
    assert len(cache) <= 12


# Packing


@pytest.mark.parametrize("per_part", [20_000, 40])
def test_packing(documents, per_part):
    t = library()
    out = packing.pack_documents(documents, pieces_per_partition=per_part)
    rows = out.collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d in documents.collect():
        ids = t.encode(d.text, add_special_tokens=False).ids + [2]
        own = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        for r in own:
            raw = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(raw)
    for members in sequences.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == [sum(x.length for x in members[:k]) for k in range(len(members))]
        assert sum(r.length for r in members) <= 1024
    used, least = packing.packing_certificate(out)
    assert used == len(sequences) and least <= used <= least * (1.05 if per_part < 100 else 1.01) + 1


def test_bounds_and_bins_on_small_cases():
    import itertools

    import numpy as np

    rng = np.random.default_rng(6)

    def best(sizes, capacity):
        for n in range(1, len(sizes) + 1):
            for way in itertools.product(range(n), repeat=len(sizes)):
                load = [0] * n
                for s, b in zip(sizes, way):
                    load[b] += s
                if max(load) <= capacity:
                    return n

    for _ in range(40):
        sizes = rng.integers(1, 11, rng.integers(1, 6))
        bins, offsets, used = packing.best_fit_decreasing(sizes, 10)
        counts = np.bincount(sizes, minlength=11)
        assert packing.lower_bound(counts, 10) <= best(sizes.tolist(), 10) <= used
        for b in range(used):
            at = np.argsort(offsets[bins == b])
            assert sizes[bins == b].sum() <= 10 and (offsets[bins == b][at] == np.r_[0, sizes[bins == b][at].cumsum()[:-1]]).all()


def test_packing_odd_rows(odd, nothing):
    out = packing.pack_documents(odd).collect()
    assert sorted(r.length for r in out if r.doc_id in (3, 4)) == [1, 1]
    assert len([r for r in out if r.doc_id == 2]) == 2 and len([r for r in out if r.doc_id is None]) == 1
    assert packing.pack_documents(nothing).collect() == []


# Line dedup


def test_lines_match_sql(spark, small):
    same_rows(lines.line_report(spark.read.parquet(f"{small}/documents.parquet")), duck(small), lines.ORACLE_SQL)


def brute_lines(rows):
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            w = line.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ")
            w = [x for x in w if x]
            if w and any(near(w, s) for s in seen):
                seen.append(w)
                continue
            if w:
                seen.append(w)
            kept.append(line)
        out[doc_id] = None if text is None else "\n".join(kept)
    return out


def near(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_lines_with_edits(spark):
    import random

    rng = random.Random(8)
    bases = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 9, 12, 30]))] for _ in range(12)]
    rows = []
    for d in range(60):
        made = []
        for _ in range(4):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                if kind == 0:
                    w.insert(at, f"n{rng.randrange(4)}")
                elif w and at < len(w):
                    w[at : at + 1] = [f"n{rng.randrange(4)}"] if kind == 1 else []
            made.append(rng.choice([" ", "  "]).join(w) + rng.choice(["", " ", "\t"]))
        rows.append((d, "\n".join(made)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == brute_lines(rows)


def test_lines_odd_rows(odd, nothing):
    out = lines.dedup_lines(odd.withColumn("n_lines", F.lit("clash")).withColumn("n_kept", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == odd.count() and "extra" in out.columns and out.columns.count("n_kept") == 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].text and by_id[2].text == "" and (by_id[4].text, by_id[4].n_lines) == (None, 0)
    assert (by_id[3].text, by_id[3].n_lines, by_id[3].n_kept) == ("", 1, 1) and by_id[6].n_kept == 2
    assert by_id[None].text == "a row without a number"
    assert lines.dedup_lines(nothing).collect() == []


def test_lines_with_clashing_names_and_another_least_length(spark):
    names = ["_key", "_lines", "_kept", "_blank", "_stay", "_out", "_copy", "_row", "_hash", "place", "line_no", "a.b", "a`c"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b c\n x y", "a b d\nx  y", "long word list of six\tx", "long word list of six y"])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_kept"]
    got = sorted(out.collect())
    assert [tuple(r)[2:-2] for r in got] == [r[2:] for r in rows] and [r.text for r in got] == ["a b c\n x y", "a b d", "long word list of six\tx", ""]
    assert [r.text for r in sorted(lines.dedup_lines(df, min_words=3).collect())] == ["a b c\n x y", "", "long word list of six\tx", ""]
    assert [r.n_kept for r in sorted(lines.dedup_lines(df, min_words=9).collect())] == [2, 1, 1, 1]


def test_a_hot_half_a_hot_line_and_very_long_lines(spark):
    """One half and one line that most documents hold, and lines of thousands of words that differ in one."""
    long = [f"w{i}" for i in range(6000)]
    rows = [(i, f"this half is in every line {i} of {i * 7} them\nthe same line again and again\nshort {i}") for i in range(300)]
    rows += [(1000, " ".join(long)), (1001, " ".join([*long[:3000], "x", *long[3001:]])), (1002, " ".join(long[:4000] + long[4001:])), (1003, " ".join(long[:100] + long[102:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert [got[i] for i in (1001, 1002)] == ["", ""] and got[1003] == rows[-1][1] and got[1000] == rows[-4][1]
    assert all(got[i] == rows[i][1].split("\n")[0] + "\n" + rows[i][1].split("\n")[2] for i in range(1, 300)) and got[0] == rows[0][1]


def test_lines_of_repeated_and_missing_ids(spark):
    line, near_line = "a b c d e f g h", "a b c d e f g z"
    for rows, stay in [
        # Equal rows: one keeps the line, and its near line elsewhere goes.
        ([(1, line), (1, line), (2, near_line)], 1),
        ([(1, line), (2, near_line), (2, near_line)], 1),
        # Different texts of one id, and of none, with the copy at the same place or another.
        ([(1, line), (1, f"{line}\nq r s")], 2),
        ([(1, f"x y\n{line}"), (1, f"v w\n{near_line}"), (1, f"t u\n{line}")], 4),
        ([(None, f"x y\n{line}"), (None, f"v w\n{near_line}"), (None, f"t u\n{line}"), (5, near_line)], 4),
        ([(None, line), (None, line), (2**63 - 1, near_line), (-(2**63), "k l")], 2),
    ]:
        out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(out) == len(rows) and sum(r.n_kept for r in out) == stay, (rows, out)
        assert sum(bool(r.text) and (line in r.text or near_line in r.text) for r in out) == 1
    assert [r.text for r in out if r.doc_id == 2**63 - 1] == [near_line]


# Language


def test_language_of_held_out_documents(documents):
    from siltworks.llm.common import crc_bucket

    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit_languages(documents, ~held)
    out = language.predict_languages(documents.filter(held), model).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and abs(sum(r.languages.values()) - 1) < 1e-6 for r in out)
    identify = language.Identifier(model)
    texts = {r.lang: r.text for r in documents.filter("length(text) > 2000").collect()}
    mixed = identify.mixture(language.words_of(texts["en"][:1500] + " " + texts["fr"][:1500]))
    assert set(mixed) == {"en", "fr"} and min(mixed.values()) > 0.25
    assert set(identify.mixture(language.words_of(texts["de"]))) == {"de"}


def test_numerals_are_no_letters(spark):
    rows = [(1, "½ ²"), (2, "Ⅷ ③ ١٢"), (3, "le ½chat"), (4, "42"), (5, "the"), (6, "１２"), (7, "_")]
    docs = spark.createDataFrame([(i, t, "fr" if i == 3 else "en") for i, t in rows], "doc_id long, text string, lang string")
    model = language.fit_languages(docs, F.col("doc_id").isin(3, 5))
    out = {r.doc_id: r for r in language.predict_languages(docs, model).collect()}
    assert [i for i in out if out[i].lang_pred == "und"] == [1, 2, 4, 6, 7] and all(out[i].score == 0 for i in (1, 2, 4, 6, 7))
    assert language.words_of("Le ½Chat Ⅷviii x²y") == ["le", "chat", "viii", "x", "y"]


def test_mixtures_by_plain_expectation_maximisation(spark):
    """The model and the mixtures by loops over words and languages, for documents of one to ten languages."""
    import math
    import random

    rng = random.Random(5)
    words = {f"l{k}": [f"{chr(97 + k)}{rng.choice('aeiou')}{chr(97 + (k * 7 + j) % 26)}{rng.choice('aeiou')}" for j in range(30)] for k in range(10)}
    train = [(i, " ".join(rng.choice(words[f"l{i % 10}"]) for _ in range(60)), f"l{i % 10}") for i in range(100)]
    asked = [(1000 + k, " ".join(rng.choice(words[f"l{j}"]) for j in range(k + 1) for _ in range(80)), None) for k in range(10)]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, F.col("doc_id") < 1000)
    got = {r.doc_id: r for r in language.predict_languages(docs, model).collect()}

    counts = {lang: {} for lang in words}
    grams = lambda w: [zlib.crc32(f"\x02{w}\x03"[i : i + 3].encode()) % language.BUCKETS for i in range(len(w))]
    for _, text, lang in train:
        for w in text.split():
            for g in grams(w):
                counts[lang][g] = counts[lang].get(g, 0) + 1
    totals = {lang: sum(c.values()) + 0.5 * language.BUCKETS for lang, c in counts.items()}

    def shares(likely, steps):
        share = [1 / len(likely[0])] * len(likely[0])
        for _ in range(steps):
            new = [0.0] * len(share)
            for row in likely:
                whole = sum(p * s for p, s in zip(row, share))
                for k, p in enumerate(row):
                    new[k] += p * share[k] / whole / len(likely)
            share = new
        return share, sum(math.log(sum(p * s for p, s in zip(row, share))) for row in likely)

    for doc_id, text, _ in asked + train[:5]:
        likely = []
        for w in text.split():
            logs = [sum(math.log((counts[x].get(g, 0) + 0.5) / totals[x]) for g in grams(w)) for x in sorted(words)]
            likely.append([math.exp(max(v - max(logs), -50)) for v in logs])
        first, _ = shares(likely, language.ITERATIONS)
        order, best, chosen = sorted(range(10), key=lambda k: -first[k]), -math.inf, None
        for k in range(1, 11):
            part, value = shares([[row[j] for j in order[:k]] for row in likely], 1 if k == 1 else language.ITERATIONS)
            value -= (k - 1) * (language.PENALTY + 0.5 * math.log(len(likely)))
            if value <= best:
                break
            best, chosen = value, {f"l{j}": p for j, p in zip(order, part)}
        assert got[doc_id].languages == pytest.approx(chosen, rel=1e-3), doc_id
    # More than eight languages are found where a document has as many.
    assert len(got[1009].languages) == 10


def test_language_odd_rows(odd, nothing):
    model = language.fit_languages(odd, F.lit(True))
    assert model.languages == ("de", "en", "fr")
    by_id = {r.doc_id: r for r in language.predict_languages(odd, model).collect()}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (3, 4, 6, 9))
    assert by_id[1].lang_pred == "en" and by_id[8].lang_pred != "und"
    none = language.fit_languages(nothing, F.lit(True))
    assert {r.lang_pred for r in language.predict_languages(odd, none).collect()} == {"und"}
    assert language.predict_languages(nothing, model).collect() == []


# Fingerprints


def plain_fingerprints(texts, low=0.001, high=0.25):
    """Of each text its hashes, by plain loops: sorted distinct terms of the band that a subset holds, hashed."""
    import re

    import xxhash

    terms = {t: sorted(set(re.findall(r"\w+", t.lower()))) for t in texts}
    frequency = {}
    for t in texts:
        for w in terms[t]:
            frequency[w] = frequency.get(w, 0) + 1
    band = {w for w, n in frequency.items() if low * len(texts) <= n <= high * len(texts)}
    bits = [0] + [2] * 2 + [4] * 4 + [6] * 12 + [8] * 24 + [10] * 24

    def of(text):
        words = sorted(set(re.findall(r"\w+", text.lower())))
        words = [w for w in words if w in band] or words
        out = []
        for k, n in enumerate(bits):
            at = k - bits.index(n)  # among the subsets of its density
            per = 64 // n if n else 1
            some = [w for w in words if not n or xxhash.xxh3_64_intdigest(w, seed=1 + 64 * n + at // per) // 2 ** (n * (at % per)) % 2**n == 0]
            out.append(format(xxhash.xxh3_64_intdigest(" ".join(some)) | 1, "016x")[8:] if some else "00000000")
        return out

    return of


def check_edits(rows, out):
    """``rows`` in order, ``out`` by id and text's length and own fingerprint."""
    of = plain_fingerprints([t for _, t in rows])

    def like(x, y):
        spoken = [a == b for a, b in zip(x, y) if (a, b) != ("00000000", "00000000")]
        return 1.0 if x == y else sum(spoken) / len(spoken)

    found = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out)
    wanted = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, other, after = of(text), of(changed), of(following)
        wanted.append((str(i), len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(own), "".join(other), round(like(own, other), 9), round(like(own, after), 9)))
    assert found == sorted(wanted)


def test_edit_report(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    out = fingerprints.edit_report(documents, stretch=17).collect()
    check_edits(rows, out)
    mean = lambda c: sum(getattr(r, c) for r in out) / len(out)
    assert mean("near_edited") > 3 * mean("near_next")


@pytest.mark.parametrize("stretch", [1, 7, 2048])
def test_edit_report_of_repeated_and_missing_ids(spark, stretch):
    """A third of the rows share an id, a third have none: they are cut by their texts, and each meets its next."""
    rng_words = [f"term{i}" for i in range(40)]
    rows = [(i if i % 3 == 0 else 77 if i % 3 == 1 else None, " ".join(rng_words[(i * k) % 40] for k in range(1, 3 + i % 9))) for i in range(120)]
    rows += [(77, ""), (None, ""), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    check_edits(order, fingerprints.edit_report(df, stretch=stretch).collect())


def test_fingerprints_odd_rows(odd, nothing, spark):
    out = fingerprints.edit_report(odd).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[3].fingerprint == by_id[4].fingerprint
    assert by_id[3].near_edited == 1.0 and by_id[4].n_chars == 0
    assert fingerprints.edit_report(nothing).collect() == []
    one = fingerprints.edit_report(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    nameless = fingerprints.edit_report(spark.createDataFrame([(None, "abcd"), (None, "efgh"), (3, "ijkl")], "doc_id long, text string"), stretch=1).collect()
    assert len(nameless) == 3
    same = fingerprints.fingerprint_documents(odd.withColumn("fingerprint", F.lit("clash")), frozenset()).collect()
    assert len({r.fingerprint for r in same if r.doc_id in (1, 2)}) == 1


# Toxicity


def test_toxicity_of_held_out_documents(spark):
    import random

    rng = random.Random(9)
    plain = [f"{a}{b}" for a in ("ka", "mo", "ti", "rel", "sun", "vor") for b in ("den", "mi", "stor", "la", "gren", "pik")]
    bad = ["gruxal", "vilbork", "snazzok"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", "***"]))
        rows.append((i, " ".join(words), int(toxic)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_table(docs, labels, F.col("doc_id") % 2 == 0)
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [r for r in rows if r[0] % 2]
    train = [r for r in rows if not r[0] % 2]
    for part in (held, train):
        assert all(out[r[0]] < 0.7 for r in part if not r[2])
        assert sum(out[r[0]] >= 0.7 for r in part if r[2]) >= 0.9 * sum(r[2] for r in part)


def test_toxicity_odd_rows(odd, nothing):
    labels = odd.select("doc_id", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") == 5, 0).alias("toxic"))
    model = toxicity.fit_table(odd, labels, F.lit(True))
    out = toxicity.score_toxicity(odd, model)
    rows = {r.doc_id: r.score for r in out.collect()}
    assert len(rows) == odd.count() - 1 and all(0 <= s <= 1 for s in rows.values()) and rows[3] == rows[4] == rows[6] and "extra" in out.columns
    assert toxicity.score_toxicity(nothing, model).collect() == []
    none = toxicity.fit_table(nothing, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}


def test_toxicity_of_rarer_languages():
    import pyarrow.parquet as pq

    from tests.conftest import TESTDATA

    where = TESTDATA / "sf0.1"
    if not where.exists():
        pytest.skip("no test tables")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(where / "labels.parquet").to_pylist()}
    rows = [(r["doc_id"], r["text"], r["lang"], labels[r["doc_id"]]) for r in pq.read_table(where / "documents.parquet").to_pylist() if r["doc_id"] in labels]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rate = toxicity.Scorer(toxicity.fit([(text, toxic) for i, text, _, toxic in rows if not held(i)])).score
    found = {}
    for i, text, lang, toxic in rows:
        if held(i):
            found.setdefault((lang, toxic), []).append(rate(text) >= 0.7)
    for lang in ("de", "en", "es", "fr"):
        assert sum(found[lang, 1]) >= 0.85 * len(found[lang, 1]) and sum(found[lang, 0]) <= 0.01 * len(found[lang, 0])
    assert sum(map(sum, (found[x, 1] for x in ("de", "en", "es", "fr")))) >= 0.9 * sum(len(found[x, 1]) for x in ("de", "en", "es", "fr"))


def test_toxicity_scores_by_brute_force():
    """Scores follow from the window lengths of all words, compressed one by one without caches or early ends."""
    import math
    import random

    import numpy as np

    rng = random.Random(4)
    plain = [f"{a}{b}" for a in ("ka", "mo", "ti", "rel", "sun", "vor") for b in ("den", "mi", "stor", "la", "gren", "pik")]
    rows = []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["gruxal", "vilbork"]))
        rows.append((" ".join(words), int(i % 5 == 0)))
    model = toxicity.fit(rows)
    marks = toxicity.marking_text([t for t, y in rows if y], [t for t, y in rows if not y])
    assert set(marks) == {"gruxal", "vilbork"}
    scorer = toxicity.Scorer(model)
    # Neither an end of a marking word nor a longer word is known.
    assert all(scorer.gain(w) >= model.cut for w in marks) and not any(scorer.gain(w) for w in [*plain, "gruxa", "uxal", "gruxals", "bork", ""])
    for text in [rows[0][0], rows[1][0], "Gruxal! gruxal kaden", "", None, "vilbork gruxal " + "kaden " * 5000]:
        words, gains = (text or "").lower().split(), {}
        for w in words:
            a, b = (len(c.compress(scorer.window(w.strip(toxicity.MARKS)))) for c in (scorer.toxic, scorer.ordinary))
            gains[w.strip(toxicity.MARKS)] = b - a if a <= model.known else 0
        told = {w for w, g in gains.items() if g >= model.cut}
        number = sum(w.strip(toxicity.MARKS) in told for w in words)
        x = [1, len(told) > 0, len(told) > 1, min(max(len(told) - 2, 0), 2), math.log1p(number), math.log1p(len(words))]
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, model.weights)))))
