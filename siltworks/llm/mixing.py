"""Mix sources to target weights by capped water-filling.

Each source gets words in proportion to its weight. A source that would repeat more than the maximum number of
epochs is clamped there and its excess goes to the others by weight, until none is above. Documents are then
taken whole: every document as often as its source's whole epochs, and the first ones of a seeded order once
more until the source's target is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.common import discard, materialise, word_count

#: Documents in one stretch of a source's seeded order; the bound on a window's rows.
STRETCH = 4096
#: Leading bits of a hash that order a source's documents.
TURN_BITS = 60


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows of ``source, source_size, weight``: min(cap, level * weight) of one water level.

    In order of cap / weight, a source is clamped as long as the level that its clamped predecessors leave
    reaches its cap. One row per source is ordered in one task, none per document.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(total)) - F.coalesce(F.sum(cap).over(earlier), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    return (
        sources.withColumns({"cap": cap, "level": left / weights, "place": F.row_number().over(order)})
        # The first source below its cap ends the clamped ones; its level is the water level.
        .withColumn("free", F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("place", "level")))
        .withColumn("level", F.min("free").over(everything)["level"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap"))
        .drop("cap", "level", "place", "free")
    )


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target of each source; weights repeat over sources by code point, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(sources.withColumn("weight", F.get(given, (F.row_number().over(order) - 1) % len(weights))))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    return water_fill(sources, total * share, max_epochs)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    keep_text: bool = False,
) -> DataFrame:
    """Decide how often each document of ``doc_id, text, source`` enters the mix.

    Returns doc_id, size, source_size, target, taken and copies, a row per input row (with ``keep_text``
    beside all columns of the input; its columns of those names are replaced). Null text has size 0; null is
    a source of its own, after all others. Documents of size 0 take 0 words and count as taken in the whole
    epochs only. The seeded order is by the MD5 of doc_id (of the text, for a null id) and seed; ties (repeated ids)
    fall in any order among themselves, with the same rows as a set. Rows are told apart by a number of their own, so
    those that share an id keep their own sizes and sources. An empty table gives no rows. A source's words differ
    from its target by less than half of one document. Other columns may have any name.
    """
    names = ("size", "source_size", "target", "taken", "copies")
    columns = [c for c in docs.columns if c not in names]
    if keep_text:
        # Written out with the rows' numbers, which a second run of the plan might give anew.
        others = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns if c != "text"])
        docs = materialise(docs.select(others.alias("_all"), "doc_id", "source", "text", F.monotonically_increasing_id().alias("_row")))
        stored = docs
    else:
        docs = docs.withColumn("_row", F.lit(0).cast("long"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", own, F.lit(str(seed)))), 1, TURN_BITS // 4), 16, 10).cast("long")
    sizes = materialise(docs.select("_row", "doc_id", "source", word_count(F.col("text")).alias("size"), turn.alias("turn")))
    targets = materialise(source_targets(sizes, weights, share, max_epochs))

    # Hash order cut into stretches: sums of stretches first, then running sums inside each.
    dealt = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]), "left").select(
        "_row", sizes["doc_id"], sizes["source"], "size", "turn", "source_size", "target",
        F.floor(F.col("turn").cast("double") / F.lit(2.0**TURN_BITS) * F.ceil(F.col("source_docs") / STRETCH)).alias("stretch"),
    )
    stretches = dealt.groupBy("source", "stretch").agg(F.sum("size").alias("stretch_size"))
    running = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("stretch_size").over(running), F.lit(0)).alias("before"))
    placed = dealt.join(stretches, dealt["source"].eqNullSafe(F.col("s")) & (dealt["stretch"] == F.col("t")))
    inside = Window.partitionBy("source", "stretch").orderBy("turn", "doc_id", "size")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.select("_row", "doc_id", "source", "size", "source_size", "target", "stretch", epochs.alias("epochs"), (start).alias("start"), F.row_number().over(inside).alias("place"))
    placed = materialise(placed.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    discard(sizes, targets)
    # The document across the end of the fraction leaves a gap; of its stretch's documents that aren't in the
    # fraction, the one whose size is nearest to the gap enters, or none if that leaves less.
    across = placed.filter((F.col("size") > 0) & (F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") > F.col("rest")))
    across = across.select(F.col("source").alias("s"), F.col("stretch").alias("t"), (F.col("rest") - F.col("start")).alias("gap"))
    outside = placed.join(across, placed["source"].eqNullSafe(F.col("s")) & (placed["stretch"] == F.col("t"))).filter(F.col("start") + F.col("size") > F.col("rest"))
    off = F.abs(F.col("size") - F.col("gap"))
    last = outside.filter(off < F.col("gap")).groupBy("s", "t").agg(F.min(F.struct(off, "place"))["place"].alias("p"))
    marked = placed.join(last, placed["source"].eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t")) & (F.col("place") == F.col("p")), "left")
    within = (F.col("size") > 0) & (F.col("start") + F.col("size") <= F.col("rest"))
    extra = F.when(within | F.col("p").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    mixed = marked.withColumn("copies", F.col("epochs") + extra).withColumn("taken", F.col("copies") * F.col("size"))
    if not keep_text:
        return mixed.select("doc_id", *names)
    mixed = materialise(mixed.select("_row", *names), merge=True)
    discard(placed)
    joined = stored.select("_row", "_all", "text").join(mixed, "_row")
    return joined.select(*[F.col("text") if c == "text" else F.col("_all").getField(c).alias(c) for c in columns], *names)


#: The query in DuckDB: running sums over each source's whole order.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || left(md5(CAST(doc_id AS VARCHAR) || ':0'), {TURN_BITS // 4}) AS BIGINT) AS turn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER earlier, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0.0)) AS level,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS place
  FROM s WINDOW earlier AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, coalesce(least(cap, (SELECT level FROM w WHERE level * weight < cap ORDER BY place LIMIT 1) * weight), cap) AS target FROM w
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    floor(d.turn / {2.0**TURN_BITS} * ceil(t.docs / {STRETCH})) AS stretch, row_number() OVER o AS place,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size)
), r AS (
  SELECT *, target - epochs * source_size AS rest FROM p
), gaps AS (
  SELECT source, stretch, rest - start AS gap FROM r WHERE size > 0 AND start < rest AND start + size > rest
), last AS (
  SELECT r.source, arg_min(r.place, (abs(r.size - g.gap), r.place)) AS place
  FROM r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source AND r.stretch = g.stretch
  WHERE r.start + r.size > r.rest AND abs(r.size - g.gap) < g.gap GROUP BY r.source
), c AS (
  SELECT r.*, r.epochs + CASE WHEN (r.size > 0 AND r.start + r.size <= r.rest) OR l.place IS NOT NULL THEN 1 ELSE 0 END AS copies
  FROM r LEFT JOIN last l ON r.source IS NOT DISTINCT FROM l.source AND r.place = l.place
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
