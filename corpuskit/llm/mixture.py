"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import write_stage

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 17
# Slices of the Pareto order per source, one per so many rows of all sources but as many as here at least; only the
# slice that holds a source's edge is sorted.
SLICES, SLICE_ROWS = 4096, 1 << 14
# Sources up to which their plan is broadcast; a larger plan is joined by key.
BROADCAST_SOURCES = 50_000

_WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 13  # hex digits of a hash that a double holds exactly


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def _odds(seed: int, doc_id: Column) -> Column:
    """Random odds ``u / (1 - u)`` that depend on seed and id only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(key.cast("binary")), 1, _DIGITS), 16, 10).cast("bigint")
    u = (digits.cast("double") + 0.5) / float(16**_DIGITS)
    return u / (1 - u)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops
    at ``cap`` times its source's size and the excess is shared again by weight. One row per source is windowed.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    # In the order of the most a source may take per unit of weight, the capped ones come first.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("left", left).withColumn("open", open_weight)
    capped = F.col("left") * F.col("weight") > F.col("most") * F.col("open")
    sources = sources.withColumn("capped", capped)
    first = F.min(F.when(~F.col("capped"), F.struct(-F.col("left"), "open"))).over(Window.partitionBy())
    share = (-first["col1"]) * F.col("weight") / first["open"]
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(share)
    return sources.select("source", "source_size", target.cast("double").alias("target"))


def _with_place(rows: DataFrame, plan: DataFrame, seed: int, slices: int) -> DataFrame:
    """Each row with its source's plan, its inclusion probability, its rank value and its slice of the Pareto order.

    Rows that are certain rank first, in a slice of their own; rows without words have no rank.
    """
    chance = F.least(F.col("pace") * F.col("size"), F.lit(1.0))
    placed = rows.join(plan, rows["source"].eqNullSafe(plan["mix_source"])).withColumn("chance", chance)
    rank = _odds(seed, F.col("doc_id")) * (1 - F.col("chance")) / F.nullif(F.col("chance"), F.lit(0.0))
    placed = placed.withColumn("rank_value", rank)
    slice_ = F.floor(F.col("rank_value") / (1 + F.col("rank_value")) * slices).cast("int")
    return placed.withColumn("slice", F.when(F.col("chance") >= 1, F.lit(-1)).otherwise(slice_))


def _plan(sizes: DataFrame, weights, cap) -> DataFrame:
    """Per source: target, whole copies of every document, words left to sample and the chance of a word's worth.

    The chance of a document is ``pace * size``, at most 1, such that the expected words of the sample are those
    wanted: ``pace`` comes from the sizes of a source, largest first, as the first size that need not be certain
    leaves it. Sizes are counted before they are sorted, so a source has as many rows here as different sizes.
    """
    targets = source_targets(sizes, weights, cap)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("copies").cast("int")
    targets = targets.withColumn("copies", copies).select(
        F.col("source").alias("mix_source"),
        "source_size",
        "target",
        whole.alias("whole"),
        F.nullif(F.col("copies") - whole, F.lit(0.0)).alias("part"),
        (F.col("target") - whole * F.col("source_size")).alias("wanted"),
    )
    targets = write_stage(targets, "targets").df
    held = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    words = F.col("n").cast("decimal(20,0)") * F.col("size").cast("decimal(17,0)")
    held = held.withColumn("words", words).withColumn("squares", F.col("words") * F.col("size").cast("decimal(17,0)"))
    before = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    larger = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("decimal(38,0)"))
    rest = F.sum("squares").over(Window.partitionBy("source")) - larger("squares")
    held = held.withColumn("larger", larger("words").cast("double")).withColumn("rest", rest.cast("double"))
    wanted = targets.where("part IS NOT NULL").select(F.col("mix_source").alias("key"), F.col("wanted").alias("lack"))
    held = held.join(_bounded(wanted), F.col("source").eqNullSafe(F.col("key")))
    lack = F.col("lack") - F.col("larger")
    pace = held.where(lack * F.col("size") <= F.col("rest")).groupBy("key").agg(
        F.max_by(lack / F.col("rest"), "size").alias("pace")
    )
    return targets.join(_bounded(pace), F.col("mix_source").eqNullSafe(F.col("key")), "left").drop("key")


def _bounded(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def allocate(
    rows: DataFrame,
    sizes: DataFrame | None = None,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
    slices: int | None = None,
) -> DataFrame:
    """Copies of every document that bring each source to its target.

    ``rows`` has ``doc_id, source, size`` and any columns besides; ``source_size, target, copies`` are added. ``sizes``
    may be a narrower table of the same rows to plan on. The whole copies in ``target / source_size`` are certain for
    every document. The words that a source still lacks are sampled with a chance in proportion to a document's size,
    where the largest may be certain too: documents are ranked by random odds over the odds of their inclusion, and a
    source takes from the front of that order as many words as it lacks, up to the document whose end or start is
    nearest. So a source misses its target by half a document at most, large ones seldom stand at that edge, and no
    document comes more than ``cap`` times.

    The order is cut into ``slices`` by rank value, by default the more the more rows there are; only the slice with a
    source's edge is sorted, so a source of any size is spread over all tasks. Random odds depend on seed and id, so
    reruns agree. A null source is a source; a null id is an id; rows that repeat an id are documents of their own;
    rows without words get certain copies only. No rows give no rows. Jobs run while it is planned.
    """
    sizes = rows.select("doc_id", "source", "size") if sizes is None else sizes
    slices = max(SLICES, sizes.count() // SLICE_ROWS) if slices is None else slices
    planned = write_stage(_plan(sizes, weights, cap), "mix").df
    plan = _bounded(planned)
    placed = _with_place(sizes, plan, seed, slices)
    cut = placed.where("part IS NOT NULL AND slice IS NOT NULL").groupBy("mix_source", "slice").agg(F.sum("size").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("mix_source").orderBy("slice"))
    cut = cut.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("held"))
    wanted = planned.select(F.col("mix_source").alias("key"), F.col("wanted").alias("lack"))
    cut = cut.join(_bounded(wanted), F.col("mix_source").eqNullSafe(F.col("key")))
    # Slices wholly inside are taken, the one that holds the edge is sorted, later ones are left.
    edge = cut.groupBy("mix_source").agg(
        F.min(F.when(F.col("end") > F.col("lack"), F.struct("slice", "begin"))).alias("edge")
    )
    edge = edge.select(F.col("mix_source").alias("key"), "edge.*").withColumnsRenamed({"slice": "edge_slice"})
    plan = planned.join(_bounded(edge), F.col("mix_source").eqNullSafe(F.col("key")), "left").drop("key")
    plan = _bounded(write_stage(plan, "mix").df)

    # The row travels as one column, so that its own columns can have any names.
    named = rows.select("doc_id", "source", "size", F.struct("*").alias("row"))
    placed = _with_place(named, plan, seed, slices)
    ranked = F.col("part").isNotNull() & F.col("slice").isNotNull()
    at_edge = ranked & F.coalesce(F.col("slice") == F.col("edge_slice"), F.lit(False))
    taken = ranked & F.coalesce(F.col("slice") < F.col("edge_slice"), F.lit(True))
    inside = placed.where(~at_edge).withColumn("extra", taken.cast("int"))
    order = Window.partitionBy("mix_source").orderBy("rank_value", "doc_id", "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = 2 * (F.col("begin") + F.col("upto")) - F.col("size") <= 2 * F.col("wanted")
    border = placed.where(at_edge).withColumn("upto", upto).withColumn("extra", near.cast("int")).drop("upto")
    both = inside.unionByName(border)
    found = both.select("row", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies"))
    kept = [F.col("row")[name].alias(name) for name in rows.columns]
    return found.select(*kept, "source_size", "target", "copies")


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The documents, with all their columns, as often as the mix takes them; sizes are words.

    See ``allocate``. Documents without words come as often as their source's certain copies say.
    """
    sizes = write_stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes").df
    own = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct("*").alias("document"))
    found = allocate(own, sizes, weights, cap, seed)
    repeated = found.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col("document")[name].alias(name) for name in docs.columns])


def mix_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: how many words of each document the mix takes."""
    sizes = write_stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes").df
    found = allocate(sizes, None, weights, cap, seed)
    taken = (F.col("copies") * F.col("size")).cast("bigint")
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


# The same as mix_sizes in DuckDB, over the view ``documents``.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, {_DIGITS}))::BIGINT + 0.5::DOUBLE)
           / {16**_DIGITS}::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             3 * source_size AS most FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (
               ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
f AS (SELECT rest, open_weight FROM o WHERE NOT rest * weight > most * open_weight
      ORDER BY most / weight, source NULLS LAST LIMIT 1),
t AS (SELECT o.source, o.source_size,
             CASE WHEN o.rest * o.weight > o.most * o.open_weight THEN o.most::DOUBLE
                  ELSE (f.rest * o.weight)::DOUBLE / f.open_weight::DOUBLE END AS target FROM o LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies FROM t),
h AS (SELECT source, size, count(*)::HUGEINT * size AS words, count(*)::HUGEINT * size * size AS squares
      FROM d WHERE size > 0 GROUP BY source, size),
g AS (SELECT source, size,
             coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS larger,
             (sum(squares) OVER (PARTITION BY source ORDER BY size DESC
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rest FROM h),
e AS (SELECT p.source, max_by((target - floor(copies) * source_size - larger) / rest, g.size) AS pace
      FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
      WHERE (target - floor(copies) * source_size - larger) * g.size <= rest GROUP BY p.source),
i AS (SELECT d.*, p.source_size, p.target, floor(copies) AS whole, copies - floor(copies) AS part,
             target - floor(copies) * source_size AS wanted, least(pace * d.size, 1) AS chance
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, (u / (1 - u)) * (1 - chance) / nullif(chance, 0) AS rank_value FROM i),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank_value NULLS LAST, doc_id NULLS FIRST, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND 2 * upto - size <= 2 * wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
