"""Near-duplicate lines by a deletion-neighbourhood join, with built-in functions only.

A line is the sequence of its words. Two lines are near when one word changed, went or came (edit distance 1
over words) and the longer one has at least ``min_words``, so that 80 % of it agrees; shorter lines are near only
if equal. The deletion neighbourhood of a line is the line without one of its words, for each of them, and
the line itself. Two lines with one word changed share a variant at the same place; a line with one word more
shares a variant with the other line whole. Positional hashes joined by exclusive or give the keys of all
variants in time linear in the line's words.

Before that, a cheap test: near lines agree in all words of their first or of their last half. Only lines that
share such a half with another line emit variants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from siltworks.llm.common import discard, materialise

#: Lines shorter than this are near only if equal: one word of five is a fifth. The default of ``min_words``.
MIN_WORDS = 5
#: White space beside the blank, which is told by its bytes before a line is rewritten.
SPACES = "\t\x0b\x0c\r\n"
#: Line numbers take the low decimal digits of a place; where ids repeat, the number of a text among its id's comes before.
_PER_DOCUMENT, _PER_ID = 10**10, 10**9


def _tidy(line: Column) -> Column:
    """The line without white space around it, all white space as single blanks; most lines need no rewriting."""
    odd = reduce(Column.__or__, [line.contains(c) for c in SPACES])
    line = F.trim(F.when(odd, F.translate(line, SPACES, " " * len(SPACES))).otherwise(line))
    return F.when(line.contains("  "), F.regexp_replace(line, " +", " ")).otherwise(line)


def _words(tidy: Column) -> Column:
    return F.split(tidy, " ")


def _place(key: str, line_no: str) -> Column:
    """A number that orders lines by row, then by line; a flat value that hash aggregation updates in place."""
    return (F.col(key).cast("decimal(28,0)") * F.lit(_PER_DOCUMENT).cast("decimal(11,0)") + F.col(line_no).cast("decimal(10,0)")).cast("decimal(38,0)")


def _place_key(place: str, kind: DataType) -> Column:
    return F.floor(F.col(place) / F.lit(_PER_DOCUMENT).cast("decimal(11,0)")).cast(kind)


def _place_line(place: str) -> Column:
    return F.pmod(F.col(place), F.lit(_PER_DOCUMENT).cast("decimal(38,0)")).cast("int")


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Add ``_key``, which orders rows by doc_id (null last), then by a hash of the text; and whether equal rows share it.

    Where each id has one text the key is the id. Otherwise it is a decimal: the id, then the text's number among
    the id's; for a null id the text's hash, so that no group gathers the nulls.
    """
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    texts = materialise(docs.groupBy("doc_id", "_hash").agg(F.count("*").alias("rows")))
    repeated = bool(texts.filter("rows > 1").take(1))
    whole = F.coalesce("doc_id", F.lit(2**63 - 1))
    several = texts.groupBy(whole.alias("doc_id")).agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    if not several.take(1):
        discard(texts)
        return docs.withColumn("_key", whole).drop("_hash"), repeated
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("_hash")) - 1
    turns = materialise(texts.filter("doc_id is not null").join(several, "doc_id", "left_semi").select("doc_id", "_hash", turn.alias("_turn")))
    discard(texts)
    if turns.filter(F.col("_turn") >= _PER_ID).take(1):
        raise ValueError(f"an id has more than {_PER_ID} texts")
    wide = lambda c: c.cast("decimal(28,0)")
    ids = wide(F.col("doc_id").cast("decimal(19,0)") * F.lit(_PER_ID).cast("decimal(10,0)") + F.coalesce("_turn", F.lit(0)))
    # Above all ids: 2**63, and the hash counted from 0.
    nulls = wide(F.lit(str(2**63 * _PER_ID + 2**63)).cast("decimal(28,0)") + F.col("_hash").cast("decimal(19,0)"))
    docs = docs.join(turns, ["doc_id", "_hash"], "left").withColumn("_key", F.when(F.col("doc_id").isNull(), nulls).otherwise(ids))
    return docs.drop("_hash", "_turn"), repeated


def _lines(docs: DataFrame, separator: str, min_words: int) -> DataFrame:
    """A row per distinct line with words: document and number of its earliest copy, hashes of its halves.

    Lines are equal if two 64-bit hashes of their words agree.
    """
    lines = docs.filter("text is not null").select("_key", F.posexplode(F.split("text", separator)).alias("line_no", "line"))
    lines = lines.select("_key", "line_no", _tidy(F.col("line")).alias("line")).filter("line <> ''")
    words = _words(F.col("line"))
    n = F.size("words")
    # A line meets lines with as many words, one more, or one fewer: half of the shorter one's words.
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    first = lambda k: F.xxhash64(F.lit(0), k, F.slice("words", 1, k))
    last = lambda k: F.xxhash64(F.lit(1), k, F.slice("words", n - k + 1, k))
    # A line of one word less than min_words can still meet one of min_words.
    long_enough, even = n >= min_words - 1, n % 2 == 0
    keyed = lines.select(_place("_key", "line_no").alias("place"), "line", words.alias("words")).select(
        F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "place",
        F.when(long_enough, first(low)).alias("h0"), F.when(long_enough, last(low)).alias("h1"),
        F.when(long_enough & even, first(high)).alias("h2"), F.when(long_enough & even, last(high)).alias("h3"),
    )
    # The halves follow from the line: all copies have the same, and none but the line's two hashes is a key.
    halves = [F.max(h).alias(h) for h in ("h0", "h1", "h2", "h3")]
    distinct = keyed.groupBy("k1", "k2").agg(F.min("place").alias("place"), *halves)
    return distinct.select(_place_key("place", docs.schema["_key"].dataType).alias("_key"), _place_line("place").alias("line_no"), "h0", "h1", "h2", "h3")


def _variant_keys(words: DataFrame, min_words: int) -> DataFrame:
    """key, _key, tag of each variant, tag = 4 * line_no + kind; ``words`` holds _key, line_no, n, i (from 0), word.

    Kinds: one word changed at i (0), one word gone (1), the line whole (2). Lines that are dealt by _key and line_no
    before they become words need no shuffle here.
    """
    z = words.select("_key", "line_no", "n", "i", F.xxhash64("i", "word").alias("own"), F.xxhash64(F.col("i") - 1, "word").alias("shifted"))
    line = Window.partitionBy("_key", "line_no").orderBy("i")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    xor = lambda c, w: F.expr(f"bit_xor({c})").over(w)
    z = z.select("_key", "line_no", "n", "i", "own", "shifted", xor("own", whole).alias("all_own"), xor("shifted", whole).alias("all_shifted"), xor("own", upto).alias("upto_own"), xor("shifted", upto).alias("upto_shifted"))
    changed = F.xxhash64(F.lit(0), "n", "i", F.col("all_own").bitwiseXOR(F.col("own")))
    # Words before i as they are, words after i one place to the left.
    gone = F.xxhash64(F.lit(1), F.col("n") - 1, F.col("upto_own").bitwiseXOR(F.col("own")).bitwiseXOR(F.col("all_shifted")).bitwiseXOR(F.col("upto_shifted")))
    variant = lambda key, kind: F.struct(key.alias("key"), (F.col("line_no") * 4 + kind).alias("tag"))
    some = F.when(F.col("n") >= min_words, F.array(variant(changed, 0), variant(gone, 1))).otherwise(F.array().cast("array<struct<key:bigint,tag:int>>"))
    some = F.when(F.col("i") == 0, F.concat(some, F.array(variant(F.xxhash64(F.lit(1), "n", "all_own"), 2)))).otherwise(some)
    return z.select("_key", F.inline(some))


def _near_lines(docs: DataFrame, distinct: DataFrame, separator: str, min_words: int) -> DataFrame:
    """_key, line_no of the distinct lines that have a near line at an earlier place."""
    halves = distinct.select("_key", "line_no", F.explode(F.array("h0", "h1", "h2", "h3")).alias("half")).filter("half is not null")
    shared = materialise(halves.groupBy("half").agg(F.count("*").alias("members")).filter("members > 1").select("half"), merge=True)
    wanted = materialise(halves.join(shared, "half").groupBy("_key").agg(F.array_distinct(F.collect_list("line_no")).alias("numbers")), merge=True)
    discard(shared)

    # The words of the suspects; one pass over the texts.
    texts = docs.select("_key", "text").join(wanted, "_key").select("_key", "numbers", F.split("text", separator).alias("lines"))
    texts = texts.select("_key", F.explode(F.expr("transform(numbers, k -> struct(k as line_no, get(lines, k) as line))")).alias("l"))
    texts = texts.select("_key", "l.line_no", _tidy(F.col("l.line")).alias("line")).filter("line <> ''").select("_key", "line_no", _words(F.col("line")).alias("words"))
    texts = materialise(texts)
    discard(wanted)

    dealt = texts.repartition("_key", "line_no").select("_key", "line_no", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    variants = materialise(_variant_keys(dealt, min_words))
    several = materialise(variants.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), merge=True)
    met = variants.join(several, "key").select("key", (F.col("tag") % 4).alias("kind"), "_key", F.floor(F.col("tag") / 4).cast("int").alias("line_no"))
    met = materialise(met.withColumn("place", _place("_key", "line_no")).drop("_key", "line_no"))
    discard(variants, several)
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place"))).alias(f"m{kind}")
    groups = materialise(met.groupBy("key").agg(least(0), least(1), least(2)), merge=True)
    witness = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = met.join(groups, "key").select("place", witness.alias("witness")).filter("witness < place").distinct()

    # The edit distance itself, on the words.
    placed = texts.select(_place("_key", "line_no").alias("place"), "words")
    both = pairs.join(placed.withColumnRenamed("words", "a"), "place").join(placed.select(F.col("place").alias("witness"), F.col("words").alias("b")), "witness")
    longer, shorter = F.when(F.size("a") >= F.size("b"), F.col("a")).otherwise(F.col("b")), F.when(F.size("a") >= F.size("b"), F.col("b")).otherwise(F.col("a"))
    both = both.select("place", longer.alias("x"), shorter.alias("y")).withColumn("at", F.expr("array_position(zip_with(x, y, (p, q) -> not(p <=> q)), true)").cast("int"))
    same_after = lambda skip: F.slice("x", F.col("at") + 1, F.size("x")) == F.slice("y", F.col("at") + skip, F.size("x"))
    one_edit = F.when(F.size("x") == F.size("y"), same_after(1)).when(F.size("x") == F.size("y") + 1, same_after(0)).otherwise(F.lit(False))
    near = both.filter((F.size("x") >= min_words) & (F.col("at") > 0) & one_edit).select("place").distinct()
    near = materialise(near.select(_place_key("place", docs.schema["_key"].dataType).alias("_key"), _place_line("place").alias("line_no")))
    discard(texts, met, groups)
    return near


def dedup_lines(docs: DataFrame, separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """Take from each text of ``doc_id, text`` the lines that an equal or near line precedes.

    Lines are ordered by doc_id (null last), then, where rows share an id or have none, by a hash of the text, then
    by place; of equal rows one is first. A line goes if any earlier line is within the edit
    bound, whether that one stays or not. Words are compared as they are, white space between them as one
    blank. Lines without words stay. Returns all columns of the input with the new ``text``, and n_lines and
    n_kept (long; columns of those names are replaced); other columns may have any name. Null texts stay null with 0
    lines; an empty text is one line without words. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    others = [c for c in columns if c != "text"]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # The other columns travel as one, so that their names meet none of the names used here.
    docs = docs.select("doc_id", "text", F.struct(*map(quoted, others)).alias("_row"))
    docs, repeated = _numbered(docs)
    narrow = docs.select("_key", "text")
    if repeated:
        narrow = narrow.dropDuplicates(["_key"])
    distinct = materialise(_lines(narrow, separator, min_words))
    near = _near_lines(narrow, distinct, separator, min_words)
    kept = distinct.select("_key", "line_no").join(near, ["_key", "line_no"], "left_anti")
    kept = materialise(kept.groupBy("_key").agg(F.collect_list("line_no").alias("_kept")), merge=True)
    discard(distinct, near)
    out = docs
    if repeated:
        # Of equal rows one keeps its lines.
        out = out.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    out = out.join(kept, "_key", "left")
    if repeated:
        out = out.withColumn("_kept", F.when(F.col("_copy") == 1, F.col("_kept")))
    out = out.withColumn("_lines", F.split("text", separator))
    out = out.withColumn("_blank", F.expr(r"filter(transform(_lines, (l, i) -> if(trim(BOTH ' \t\u000b\f\r\n' FROM l) = '', i, null)), i -> i is not null)"))
    out = out.withColumn("_stay", F.array_sort(F.array_union(F.coalesce("_kept", F.array().cast("array<int>")), "_blank")))
    out = out.withColumn("_out", F.expr("filter(transform(_stay, k -> get(_lines, k)), l -> l is not null)"))
    size = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    text = F.when(F.col("text").isNotNull(), F.array_join("_out", separator))
    return out.select(*[text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns], size("_lines").alias("n_lines"), size("_out").alias("n_kept"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and the MD5 of each text that stays (null for null).

    A row per input row: repeated rows, rows without an id, ties, empty and very long texts as ``dedup_lines`` has
    them. An empty table gives no rows; extra columns are not read.
    """
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


#: The same in DuckDB: near lines by comparing words one by one among lines that share a half.
ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), occ AS (
  SELECT doc_id, i - 1 AS line_no, list_filter(regexp_split_to_array(lines[i], '[ 	-
]+'), lambda w: w <> '') AS words
  FROM split, unnest(range(1, len(lines) + 1)) AS r(i)
), keyed AS (
  SELECT doc_id, line_no, words, array_to_string(words, ' ') AS line FROM occ WHERE len(words) > 0
), lines AS (
  SELECT line, any_value(words) AS words, any_value(len(words)) AS n, min((doc_id, line_no)) AS place FROM keyed GROUP BY line
), halves AS (
  SELECT DISTINCT line, words, n, place, k, side,
    CASE WHEN side = 0 THEN array_to_string(words[1:k], ' ') ELSE array_to_string(words[n - k + 1:n], ' ') END AS half
  FROM lines, unnest([(n - 1) // 2, n // 2]) AS t(k), unnest([0, 1]) AS u(side) WHERE n >= 4
), near AS (
  SELECT DISTINCT a.line
  FROM halves a JOIN halves b ON a.half = b.half AND a.k = b.k AND a.side = b.side AND a.place > b.place AND abs(a.n - b.n) <= 1 AND greatest(a.n, b.n) >= 5
  WHERE CASE
    WHEN a.n = b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.words[i] <> b.words[i])) = 1
    WHEN a.n > b.n THEN len(list_filter(range(1, a.n + 1), lambda i: a.words[1:i - 1] || a.words[i + 1:a.n] = b.words)) > 0
    ELSE len(list_filter(range(1, b.n + 1), lambda i: b.words[1:i - 1] || b.words[i + 1:b.n] = a.words)) > 0 END
), stay AS (
  SELECT place FROM lines WHERE line NOT IN (SELECT line FROM near)
), kept AS (
  SELECT s.doc_id, s.text, s.lines, list_filter(range(1, len(s.lines) + 1),
    lambda i: NOT regexp_matches(s.lines[i], '[^ 	-
]') OR list_contains(k.places, i - 1)) AS stay_at
  FROM split s LEFT JOIN (SELECT place[1] AS doc_id, list(place[2]) AS places FROM stay GROUP BY 1) k ON s.doc_id = k.doc_id
)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(stay_at), 0) AS BIGINT) AS n_kept,
  CASE WHEN text IS NOT NULL THEN md5(array_to_string(list_transform(stay_at, lambda i: lines[i]), chr(10))) END AS kept_md5
FROM kept
"""
