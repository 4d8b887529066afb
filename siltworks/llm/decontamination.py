"""Benchmark decontamination by winnowing, with built-in functions only.

A text is the sequence of its words. An item's windows are its runs of ``window`` words; an item of fewer words is one
window. Of each window's k-grams (k is half a window) the least hash is kept, once for consecutive windows. Equal
windows have equal least hashes, so the join of documents and items on them misses no shared span of a window's length
or more; a document sends about two hashes for each half window of words. Hits are extended on the words: the windows
that hold a hash that met are compared with the items' windows as text, and those found merge into spans.

Documents never meet items pairwise. They meet distinct windows; windows of the same items are one class, and documents
with the same classes share one list of items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import LETTERS_LOWER, LETTERS_UPPER, col, discard, materialise, other_columns

#: Words are runs of ASCII letters and digits and of all that is not ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window.
WINDOW = 10
_SPANS = "array<struct<start:int,length:int>>"
#: All of ASCII that is in no word.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _words(text: Column) -> Column:
    """The words of a text, A-Z as a-z; null text has none."""
    apart = F.translate(text, LETTERS_UPPER + _BETWEEN, LETTERS_LOWER + " " * len(_BETWEEN))
    return F.coalesce(F.array_remove(F.split(apart, " "), ""), F.array().cast("array<string>"))


def _grams(length: int) -> tuple[int, int]:
    """Words of a gram, and grams of a window."""
    k = (length + 1) // 2
    return k, length - k + 1


def _marks(texts: DataFrame, length: int) -> DataFrame:
    """row, length, mark, low: the least gram hash of a window, where it is not the very gram of the window before, and the window's start.

    ``texts`` has ``row``, ``text``, the words joined by blanks, and ``n``, their number. Each gram is hashed once. Places
    and their least grams are compiled expressions whose code is as short for any window: the JVM never compiles a method
    of more than 8000 bytes. Windows that add nothing go before any shuffle.
    """
    k, w = _grams(length)
    hashed = texts.filter(F.col("n") >= length).select("row", F.expr("transform(split(text, ' '), w -> xxhash64(w))").alias("hs"))
    gram = ", ".join(["h", *[f"get(hs, i + {j})" for j in range(1, k)]])
    grams = hashed.select("row", F.expr(f"transform(slice(hs, 1, size(hs) - {k - 1}), (h, i) -> xxhash64({length}, {gram}))").alias("gs"))
    places = grams.select("row", "gs", F.explode(F.expr(f"sequence(0, size(gs) - {w})")).alias("low"))
    # A window adds nothing if its least gram is neither the one that has come nor follows an equal or lesser one that has
    # left: none stands for more windows than hold it. Where one that has come equals the least, that is one more.
    adds = f"low = 0 or coalesce(array_min(slice(gs, low + 1, {w - 1})) >= least(get(gs, low - 1), get(gs, low + {w - 1})), true)"
    return places.filter(adds).select("row", F.lit(length).alias("length"), F.expr(f"array_min(slice(gs, low + 1, {w}))").alias("mark"), "low")


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, length, text of each distinct window of each item."""
    words = items.select("item", _words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.size("words"), F.lit(window)))
    cut = F.expr("transform(sequence(0, size(words) - length), i -> array_join(slice(words, i + 1, length), ' '))")
    return materialise(words.select("item", "length", F.explode(cut).alias("text")).distinct())


def _marked(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """text, mark and the class of each distinct window; a class (c1, c2) is 128 bits that tell the set of its items."""
    item = lambda salt: F.expr(f"bit_xor(xxhash64({salt}, item))")
    df = windows.groupBy("text", "length").agg(item(0).alias("c1"), item(1).alias("c2"))
    texts = df.select(F.struct("text", "c1", "c2").alias("row"), "text", F.col("length").alias("n"))
    return materialise(reduce(DataFrame.unionByName, [_marks(texts.filter(F.col("n") == n), n) for n in lengths]).select("row.*", "mark"))


def _with_spans(df: DataFrame, window: int) -> DataFrame:
    """Add ``spans``, the maximal (start, length) that the windows of ``found``, sorted (start, length), cover together."""
    # Of one start the longest window counts. A window ends after all earlier ones but those of the last few starts.
    df = df.withColumn("f", F.expr("filter(found, (x, i) -> get(found, i + 1) is null or get(found, i + 1).start <> x.start)"))
    ends = ", ".join(f"get(f, i - {j}).start + get(f, i - {j}).length" for j in range(window))
    df = df.withColumn("ends", F.expr(f"transform(f, (x, i) -> greatest({ends}, 0))"))
    df = df.withColumn("firsts", F.expr("filter(transform(f, (x, i) -> if(i = 0 or x.start > ends[i - 1], i, null)), i -> i is not null)"))
    span = "struct(f[b].start as start, coalesce(get(ends, get(firsts, j + 1) - 1), element_at(ends, -1)) - f[b].start as length)"
    return df.withColumn("spans", F.expr(f"transform(firsts, (b, j) -> {span})")).drop("f", "ends", "firsts")


def _found(docs: DataFrame, text: Column, rest: Column, items: DataFrame, window: int) -> DataFrame:
    """rest, n, found, of: what travels with each document, its words, spans and items; ``items`` has item and text."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), rest.alias("rest"), _words(text).alias("words"))
    # Words are kept joined by blanks, so that they are told apart once.
    texts = materialise(words.select("row", "rest", F.size("words").alias("n"), F.array_join("words", " ").alias("text")))
    windows = _item_windows(items, window)
    # At most ``window`` numbers.
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    if not lengths:
        return texts.select("rest", "n", F.array().cast(_SPANS).alias("found"), F.array().cast("array<string>").alias("of"))
    marked = _marked(windows, lengths)
    marks = materialise(marked.select("mark").distinct())
    met = reduce(DataFrame.unionByName, [_marks(texts, n) for n in lengths]).join(marks, "mark", "left_semi")
    met = materialise(met.groupBy("row").agg(F.collect_list(F.struct("length", "low")).alias("met")))

    # The hits, extended on the words: a gram is the least one of as many windows as a window has grams, at most.
    near = texts.select("row", "text").join(met, "row").select("row", "met", F.split("text", " ").alias("words"))
    near = near.select("row", "words", F.inline("met"))
    last = "least(low + length - cast((length + 1) div 2 as int), size(words) - length)"
    cut = F.expr(f"transform(sequence(low, {last}), i -> struct(i as start, length, array_join(slice(words, i + 1, length), ' ') as text))")
    near = near.select("row", F.inline(cut))
    hits = materialise(near.join(marked.select("text", "c1", "c2"), "text").select("row", "start", "length", "c1", "c2"))
    of_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("found"), F.array_sort(F.collect_set(F.struct("c1", "c2"))).alias("classes"))
    of_row = _with_spans(of_row, window).select("row", F.col("spans").alias("found"), "classes", F.xxhash64(F.lit(0), "classes").alias("s1"), F.xxhash64(F.lit(1), "classes").alias("s2"))
    of_row = materialise(of_row)

    # One list of items for all documents of the same classes.
    members = marked.groupBy("c1", "c2").agg(F.min("text").alias("text")).join(windows, "text").select("c1", "c2", "item")
    lists = of_row.groupBy("s1", "s2").agg(F.first("classes").alias("classes")).select("s1", "s2", F.inline("classes"))
    lists = lists.join(members, ["c1", "c2"]).groupBy("s1", "s2").agg(F.array_sort(F.collect_set("item")).alias("of"))
    lists = materialise(lists)
    found = materialise(of_row.select("row", "found", "s1", "s2").join(lists, ["s1", "s2"]).select("row", "found", "of"))
    discard(windows, marked, marks, met, hits, of_row, lists)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return texts.select("row", "rest", "n").join(found, "row", "left").select("rest", "n", none("found", _SPANS), none("of", "array<string>"))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    n_words: str = "n_words",
    spans: str = "spans",
    item_ids: str = "item_ids",
) -> DataFrame:
    """Add to each document its words (int), the spans of words that benchmark windows cover, and the items they are of.

    ``spans`` are (start, length) in words, maximal, in order; ``item_ids`` are the ids as text, sorted. A null
    or empty text has no words; a null or empty item has no windows. Items that share an id are one item, those
    without one are an item named by the empty text. Rows of documents are independent: repeated rows and repeated or null
    ids have a result each. Texts of any length are taken whole. Without documents there are no rows, without items no
    spans. Columns of the input are kept whatever their names; ones called like an output, in any case, are replaced.
    """
    kept = other_columns(docs, n_words, spans, item_ids)
    # They travel as one, so that their names meet none of the names used here.
    rest = F.struct(*map(col, kept)) if kept else F.lit(None).cast("int")
    found = _found(docs, col(text), rest, _items(items, item_text, item_id), window)
    return found.select(*[F.col("rest").getField(c).alias(c) for c in kept], F.col("n").alias(n_words), F.col("found").alias(spans), F.col("of").alias(item_ids))


def _items(items: DataFrame, text: str, item_id: str) -> DataFrame:
    return items.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("item"), col(text).alias("text"))


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document; the rules of ``find_contamination`` hold.

    Extra columns are not read. The digest of no items is that of the empty text.
    """
    found = _found(docs, F.col("text"), F.struct("doc_id"), _items(items, "text", "item_id"), WINDOW)
    n_hit = F.aggregate("found", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    digest = F.sha2(F.array_join("of", ",").cast("binary"), 256)
    counts = found.select("rest.doc_id", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("of").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return counts.withColumn("contaminated", F.col("n_hit") > 0)


_WORDS_SQL = f"""regexp_extract_all(translate(coalesce(text, ''), '{LETTERS_UPPER}', '{LETTERS_LOWER}'), '{WORD_PATTERN}')"""
#: Every window of every document against every window of every item.
ORACLE_SQL = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
w AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS t, array_to_string(w[s + 1 : s + least(len(w), {WINDOW})], ' ') AS x
  FROM (SELECT *, unnest(range(len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
p AS (SELECT doc_id, t, s, array_to_string(w[s + 1 : s + t], ' ') AS x
  FROM (SELECT doc_id, w, t, unnest(range(len(w) - t + 1)) AS s FROM d, (SELECT DISTINCT t FROM w))),
h AS (SELECT DISTINCT doc_id, t, s, item FROM p JOIN w USING (t, x)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + t)) AS k FROM (SELECT DISTINCT doc_id, t, s FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
