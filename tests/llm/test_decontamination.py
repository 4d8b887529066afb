import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from siltworks.llm import decontamination
from siltworks.llm.decontamination import contamination_report, find_contamination
from tests.oracle import duck, same_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(decontamination.WORD_PATTERN, (text or "").translate(UPPER))


def brute(docs, items, window=10):
    """(words hit, items) of each text, by comparing all windows."""
    cut = {}
    for i, text in items:
        w = words(text)
        t = min(window, len(w))
        for s in range(len(w) - t + 1 if w else 0):
            cut.setdefault(tuple(w[s : s + t]), set()).add("" if i is None else str(i))
    out = []
    for text in docs:
        w, hit, of = words(text), set(), set()
        for t in {len(c) for c in cut}:
            for s in range(len(w) - t + 1):
                if found := cut.get(tuple(w[s : s + t])):
                    hit.update(range(s, s + t))
                    of |= found
        out.append((len(w), hit, sorted(of)))
    return out


def check(spark, docs, items, window=10):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id int, text string")
    found = {r.doc_id: r for r in find_contamination(d, i, window=window).collect()}
    for n, (n_words, hit, of) in enumerate(brute(docs, items, window)):
        r = found[n]
        spans = [set(range(s.start, s.start + s.length)) for s in r.spans]
        assert (r.n_words, r.item_ids) == (n_words, of)
        assert set().union(*spans) == hit and sum(map(len, spans)) == len(hit)
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, letters: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i % 25, text(rng.choice([0, 1, 2, 3, 5, 7, 9, 10, 11, 30, 60]), ["a", "B", "cé", "7"] if i % 2 else [f"w{j}" for j in range(40)])) for i in range(40)]
    items += [(None, "one two three four five six seven eight nine ten eleven"), (99, None), (98, ""), (97, "...")]
    docs = [text(rng.randrange(120), ["a", "b", "Cé", "7", "_x"]) for _ in range(40)]
    for _ in range(40):
        w = words(rng.choice(items)[1])
        a = rng.randrange(len(w) + 1)
        docs.append(f"{text(20, ['q', 'r'])}, {' -- '.join(w[a : a + rng.randrange(40)]).upper()}! {text(5, ['q', 'r'])}")
    docs += [None, "", " \t", "One TWO three; four five_six seven eight nine TEN", "x" * 10_000]
    check(spark, docs, items)
    check(spark, docs[40:], [i for i in items if len(words(i[1])) >= 10])


def test_every_shared_span_of_a_window_is_found(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [" ".join(["left"] * (n % 7) + item[n : n + size] + ["right"] * 3) for n in range(40) for size in (9, 10, 11)]
    check(spark, docs, [(1, " ".join(item))])


def test_small_windows(spark):
    rng = random.Random(7)
    docs = [" ".join(rng.choice("abc") for _ in range(rng.randrange(15))) for _ in range(30)]
    for window in (1, 2, 3):
        check(spark, docs, [(1, "a b a"), (2, "c"), (3, "b b")], window)


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (1, "123 456"), (2, "x" * 20_000), (None, "été")], "item_id int, text string")
    out = contamination_report(odd, items).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in by[2]] == [(10, 10, 1, True)] * 2
    assert [(by[k][0].n_words, by[k][0].n_hit) for k in (3, 4, 6, None, 8, 9)] == [(0, 0), (0, 0), (0, 0), (5, 0), (1, 1), (2, 2)]
    assert by[4][0].items_sha256 == hashlib.sha256(b"").hexdigest() and by[7][0].n_hit == 1
    assert by[9][0].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert contamination_report(nothing, items).count() == 0
    assert {r.n_hit for r in contamination_report(odd, items.limit(0)).collect()} == {0}


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z")], "doc_id long, `te``xt` string, row string, `Spans` string, `met.low` string")
    items = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    out = find_contamination(docs, items, text="te`xt")
    assert out.columns == ["doc_id", "te`xt", "row", "met.low", "n_words", "spans", "item_ids"]
    assert [(r[1], r[2], r[3], r.n_words, [tuple(s) for s in r.spans], r.item_ids) for r in out.collect()] == [("a b c", "x", "z", 3, [(0, 2)], ["1"])]


def test_a_hot_passage(spark):
    """A third of all rows share a passage that many items hold: no row per document and item."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.range(3000).selectExpr("id as doc_id", f"if(id % 3 = 0, concat('{passage} ', id), concat('w', id, ' of its own')) as text")
    items = spark.range(300).selectExpr("cast(id as int) as item_id", f"concat('i', id, ' {passage}') as text")
    out = contamination_report(docs, items)
    rows = out.groupBy("n_hit", "n_items", "contaminated").count().collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in rows) == [(0, 0, False, 2000), (30, 300, True, 1000)]


def test_no_python_on_the_way(spark, documents, small):
    out = contamination_report(documents, spark.read.parquet(f"{small}/benchmark.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_same_as_sql(spark, small):
    from siltworks.llm.queries import queries

    same_rows(queries()["op13_winnowing_decontamination"](spark, small), duck(small), decontamination.ORACLE_SQL)


@pytest.mark.parametrize("n", [4, 60])
def test_repeats_inside_items_and_documents(spark, n):
    check(spark, ["a " * n + "b", "a b " * n, "c " * 12], [(1, "a " * n), (2, "a b " * 20), (3, "c " * 11)])


@pytest.mark.parametrize("window", [10, 50])
def test_marks_are_code_that_the_jvm_compiles(spark, window):
    """The JVM leaves methods of more than 8000 bytes to its interpreter, which takes ten times as long."""
    texts = spark.createDataFrame([(1, 3, "a b c")], "row long, n int, text string")
    texts = texts.withColumn("hs", F.expr("transform(split(text, ' '), w -> xxhash64(w))"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    code = decontamination._marks(texts, window)._jdf.queryExecution().explainString(mode)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_a_window_of_many_words(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(1, text(90)), (2, text(50)), (3, "a " * 60)]
    docs = [f"{text(30)} {' '.join(words(items[n % 3][1])[n % 7 : n % 7 + 43 + n % 11])} {text(9)}" for n in range(40)]
    check(spark, docs, items, 47)
