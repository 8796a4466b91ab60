"""URL filtering by rules and by the ratio of two variable-order Markov models of characters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.words import mix, raw_bytes, slices, windows
from corpuskit.session import write_stage

ALLOW, BLOCK = "allow", "block"
RULES = (
    ("org/", ALLOW),
    ("example.org/es/", BLOCK),
    ("example.org/en/1", BLOCK),
    ("com/fr/", ALLOW),
    ("com/de/", BLOCK),
)
# Longest context of a model, and least count of a kept gram.
ORDER = 5
LEAST = 2
# Grams from this share of all symbols on are broadcast, so that many at most; the others are joined.
SHARED_GRAMS = 400_000
# Scores are added up in whole units of a billionth.
UNITS = 10**9
# Bytes of URLs handled at once; a longer URL is handled alone.
URL_BYTES = 1 << 17
# Every so many labelled URLs settle the threshold and are not learned from.
CALIBRATION = 5
# Scores, nats per character, fall into bins of this width when the threshold is chosen.
BIN = 0.01

_START, _END, _SYMBOLS = 256, 257, 258
_GRAMS = "level int, context bigint, gram bigint, shorter bigint, n bigint, good bigint, bad bigint"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; null without one."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        name, says = F.when(fits, rule).otherwise(name), F.when(fits, verdict).otherwise(says)
    return name, says


def grams(urls: pa.Array, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """``(owner, contexts, grams)``: per context length a hash of the context and of the context with its symbol.

    A symbol is a byte of the URL or its end; URLs are led by start symbols, so every context is whole.
    """
    raw, offsets = raw_bytes(urls)
    sizes = np.diff(offsets)
    count = len(sizes)
    begin = np.arange(count) * (order + 1) + offsets[:-1]
    symbols = np.full(len(raw) + count * (order + 1), _START, np.uint64)
    owner_of_byte = np.repeat(np.arange(count), sizes)
    symbols[np.arange(len(raw)) + (owner_of_byte + 1) * order + owner_of_byte] = raw
    ends = begin + order + sizes
    symbols[ends] = _END
    hashes = mix(symbols)
    owner = np.repeat(np.arange(count), sizes + 1)
    at = np.arange(len(raw) + count) + (owner + 1) * order
    salts = [np.uint64(k) for k in range(order + 2)]
    spans = [np.zeros(len(symbols), np.uint64), *(windows(hashes, k) for k in range(1, order + 2))]
    contexts = [mix(spans[k][at - k] + salts[k]) for k in range(order + 1)]
    whole = [mix(spans[k + 1][at - k] ^ salts[k + 1]) for k in range(order + 1)]
    return owner, contexts, whole


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Distinct grams of a part of a batch: how often they occur in all URLs, in accepted and in rejected ones."""
    for part in (x for batch in batches for x in slices(batch, "url", URL_BYTES)):
        label = part.column(1).to_numpy(zero_copy_only=False)
        owner, contexts, whole = grams(part.column(0), order)
        label = label[owner]
        for level, (context, gram) in enumerate(zip(contexts, whole)):
            keys, first, at = np.unique(gram, return_index=True, return_inverse=True)
            shorter = whole[level - 1][first] if level else np.zeros(len(keys), np.uint64)
            sums = [np.bincount(at, mask, len(keys)).astype(np.int64) for mask in (None, label > 0, label < 0)]
            hashes = [pa.array(x.view(np.int64)) for x in (context[first], keys, shorter)]
            yield pa.record_batch(
                [pa.array(np.full(len(keys), level, np.int32)), *hashes, *map(pa.array, sums)],
                ["level", "context", "gram", "shorter", "n", "good", "bad"],
            )


def log_ratios(urls: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """``(gram, n, ratio)`` for every symbol with its longest context that occurs in ``urls (url, label)``.

    ``label`` is 1 for accepted URLs, -1 for rejected ones and 0 for those not learned from; ``ratio`` is the log of a
    gram's chance under the accepted model less that under the rejected one, in units of ``1 / UNITS``. Both models
    hold all grams that were learned ``least`` times. A context's estimate is mixed with the next shorter one's in
    proportion to the kinds of symbols seen after it (Witten and Bell); unknown contexts leave that as it is.

    Counts stay distributed. A gram takes the shorter estimate from the gram without its first symbol; as rows are
    distinct grams, no key of these joins, and no context, has more rows than there are symbols.
    """
    counted = urls.select("url", F.col("label").cast("int")).mapInArrow(
        lambda batches: _counted(batches, order), _GRAMS
    )
    held = counted.groupBy("gram").agg(
        *[F.min(c).alias(c) for c in ("level", "context", "shorter")], *[F.sum(c).alias(c) for c in ("n", "good", "bad")]
    )
    kept, context = F.col("good") + F.col("bad") >= least, Window.partitionBy("context")
    for side in ("good", "bad"):
        held = held.withColumn(f"{side}_seen", F.when(kept, F.col(side)).otherwise(F.lit(0)))
    for side in ("good", "bad"):
        seen = F.col(f"{side}_seen")
        held = held.withColumn(f"{side}_kinds", F.sum((seen > 0).cast("int")).over(context))
        held = held.withColumn(f"{side}_mass", F.sum(seen).over(context) + F.col(f"{side}_kinds"))
    held = write_stage(held.drop("context", "good", "bad"), "grams").df
    estimates = None
    for level in range(order + 1):
        here = held.where(F.col("level") == level)
        if estimates is not None:
            here = here.join(estimates, "shorter")
        chances = {}
        for side in ("good", "bad"):
            lower = F.lit(1 / _SYMBOLS) if estimates is None else F.col(f"{side}_chance")
            mixed = (F.col(f"{side}_seen") + F.col(f"{side}_kinds") * lower) / F.col(f"{side}_mass")
            chances[side] = F.when(F.col(f"{side}_mass") > 0, mixed).otherwise(lower)
        columns = [chance.alias(f"{side}_chance") for side, chance in chances.items()]
        estimates = here.select(F.col("gram").alias("shorter"), "n", *columns)
        if level < order:
            estimates = estimates.drop("n")
    ratio = F.round((F.log("good_chance") - F.log("bad_chance")) * UNITS).cast("bigint")
    return estimates.select(F.col("shorter").alias("gram"), "n", ratio.alias("ratio"))


def with_scores(rows: DataFrame, ratios: DataFrame, order: int = ORDER, shared_grams: int = SHARED_GRAMS) -> DataFrame:
    """``rows`` with ``score``: the mean of ``ratios`` over the symbols of ``url``, which must all be in ``ratios``.

    Grams that make up at least one in ``shared_grams`` of all symbols, so no more than that many, are broadcast and
    summed in the tasks. The others of a URL are joined, where a key has fewer rows than that share. Sums are of whole
    numbers, so reruns agree. ``rows`` has no columns ``spot`` and ``parts``.
    """
    total = ratios.agg(F.sum("n")).first()[0] or 0
    often = ratios.where(F.col("n") * shared_grams >= total).select("gram", "ratio").toArrow().sort_by("gram")
    shared = rows.sparkSession.sparkContext.broadcast((often["gram"].to_numpy(), often["ratio"].to_numpy()))
    kind = pa.struct([("known", pa.int64()), ("size", pa.int64()), ("missing", pa.list_(pa.int64()))])

    def looked_up(urls: pa.Array) -> pa.Array:
        keys, values = shared.value
        owner, _, whole = grams(urls, order)
        wanted = whole[order].view(np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
        running = np.zeros(len(wanted) + 1, np.int64)
        running[1:][found] = values[at[found]]
        running = np.cumsum(running)
        bounds = np.searchsorted(owner, np.arange(len(urls) + 1))
        left = np.concatenate([[0], np.cumsum(~found)])[bounds].astype(np.int32)
        missing = pa.ListArray.from_arrays(pa.array(left), pa.array(wanted[~found]))
        columns = [pa.array(np.diff(running[bounds])), pa.array(np.diff(bounds).astype(np.int64)), missing]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    @F.arrow_udf("struct<known: bigint, size: bigint, missing: array<bigint>>")
    def summed(urls: pa.Array) -> pa.Array:
        parts = slices(pa.record_batch([urls], ["url"]), "url", URL_BYTES)
        return pa.concat_arrays([pa.array([], kind), *(looked_up(part.column(0)) for part in parts)])

    # Written once, so that the numbers of the rows stay the same.
    placed = rows.withColumn("parts", summed(F.coalesce("url", F.lit(""))))
    placed = write_stage(placed.withColumn("spot", F.monotonically_increasing_id()), "urls").df
    rest = placed.select("spot", F.explode("parts.missing").alias("gram")).join(ratios.select("gram", "ratio"), "gram")
    rest = rest.groupBy("spot").agg(F.sum("ratio").alias("rest"))
    score = (F.col("parts.known") + F.coalesce("rest", F.lit(0))) / (F.col("parts.size") * UNITS)
    return placed.join(rest, "spot", "left").withColumn("score", score).drop("spot", "parts", "rest")


def threshold(scores: DataFrame, width: float = BIN) -> float:
    """The score that parts ``(accepted, score)`` rows best: highest mean accuracy of both classes, then nearest 0."""
    bins = scores.groupBy(F.floor(F.col("score") / width).alias("bin")).agg(
        F.sum(F.col("accepted").cast("bigint")).alias("good"), F.sum((~F.col("accepted")).cast("bigint")).alias("bad")
    )
    rows = sorted(bins.collect())  # bounded by the range of log-probabilities over the width
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    options, below_good, below_bad, end = [], 0, 0, rows[0]["bin"]
    for row in [*rows, None]:
        # Between two filled bins the edge lies half-way.
        edge = width * (end + (row["bin"] if row else end)) / 2
        options.append((below_bad / bad - below_good / good, -abs(edge), edge))
        if row:
            below_good, below_bad, end = below_good + row["good"], below_bad + row["bad"], row["bin"] + 1
    return max(options)[2]


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    order: int = ORDER,
    least: int = LEAST,
    shared_grams: int = SHARED_GRAMS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every URL.

    A rule names a domain, which it fits with all subdomains, and the beginning of a path; the longest that fits
    decides. URLs that rules decide teach the models: one of accepted and one of rejected URLs, over their bytes, with
    contexts of up to ``order`` symbols. All others are judged by the difference of both log-likelihoods per symbol
    against a threshold, chosen on a fifth of the labelled URLs that the models did not learn from.

    A null URL has empty host and path and is scored as an empty one. Where rules label no URL, or all alike, there is
    no model and no score: the verdict is the only label's, or ``allow``. Repeated rows are rows of their own; no rows
    give no rows; other columns are ignored. Jobs run while the result is planned.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    held_back = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0
    rows = rows.withColumn("accepted", F.col("says") == ALLOW).withColumn("held_back", held_back)
    learned = F.when(F.col("accepted") & ~F.col("held_back"), 1).when(~F.col("accepted") & ~F.col("held_back"), -1)
    labels = rows.select(F.coalesce("url", F.lit("")).alias("url"), F.coalesce(learned, F.lit(0)).alias("label"))
    if {row["label"] for row in labels.select("label").distinct().collect()} >= {1, -1}:
        ratios = write_stage(log_ratios(labels, order, least), "ratios").df
        found = write_stage(with_scores(rows, ratios, order, shared_grams).drop("url"), "scores").df
        edge = threshold(found.where("accepted IS NOT NULL AND held_back"))
        verdict = F.coalesce("says", F.when(F.col("score") >= edge, ALLOW).otherwise(BLOCK))
    else:
        only = rows.where("accepted IS NOT NULL").select("accepted").distinct().collect()
        other = BLOCK if [r["accepted"] for r in only] == [False] else ALLOW
        found = rows.withColumn("score", F.lit(None).cast("double"))
        verdict = F.coalesce("says", F.lit(other))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
