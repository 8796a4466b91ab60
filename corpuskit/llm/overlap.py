"""Near copies by Jaccard similarity of word shingles: a grouped prefix join, checked exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import sketch
from corpuskit.llm.components import components
from corpuskit.llm.passages import doc_key, text_mark
from corpuskit.llm.words import mix, slices, split, window_mask, windows
from corpuskit.session import write_stage

SHINGLE = 5
# Two sets are linked from this similarity on, in hundredths.
PERCENT = 80
# Sets, and shingles, that a block of similar sets may hold.
BLOCK_SETS = 256
BLOCK_SHINGLES = 200_000
# Sets of one group that are dealt into a block together.
GROUP_SETS = 32
_COLUMNS = 4096
# Bytes of text per shingle in a prefix, to size the sketch.
_PREFIX_BYTES = 18

_SETS = "doc bigint, mark bigint, n bigint, node binary, tokens array<bigint>, shingles binary"
_LINKS = "a binary, b binary"


def needed(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap of a set of ``n`` with any set it is linked with."""
    return -(-n * percent // 100)


def extra(n: np.ndarray) -> np.ndarray:
    """How many shared shingles the prefixes are made to hold, beyond the one that a plain prefix holds."""
    return np.maximum(1, n // 8)


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in order of hash, and their bounds.

    Words are folded to lower case (A-Z). A text of fewer words is one shingle; one without words has none.
    """
    words = split(texts, fold=True)
    counts = words.counts()
    inside = window_mask(words.bounds, width, len(words.hashes))
    at = np.flatnonzero(inside)
    values, owner = windows(words.hashes, width)[at], np.searchsorted(words.bounds, at, side="right") - 1
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = windows(words.hashes, n)[words.bounds[short]]
            values, owner = np.append(values, mix(whole + np.uint64(n))), np.append(owner, short)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(words) + 1))


def _in_prefix(bounds: np.ndarray, percent: int) -> np.ndarray:
    n = np.diff(bounds)
    length = np.where(n > 0, n - needed(n, percent) + extra(n), 0)
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) < np.repeat(length, n)


def prefix_keys(part: pa.RecordBatch, width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shingles of their prefixes."""
    values, bounds = shingle_sets(part.column(part.schema.get_field_index("text")), width)
    prefix = _in_prefix(bounds, percent)
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[prefix], values[prefix]


def _sets(batches: Iterator[pa.RecordBatch], width: int, percent: int, counted) -> Iterator[pa.RecordBatch]:
    """A row per document; shingles only where enough of the prefix may be in other prefixes too."""
    for part in (x for batch in batches for x in slices(batch)):
        values, bounds = shingle_sets(part.column(2), width)
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        prefix = _in_prefix(bounds, percent)
        prefix[prefix] = counted.is_repeated(values[prefix])
        shared = np.bincount(owner[prefix], minlength=len(n))
        taken = (n > 0) & (shared >= extra(needed(n, percent)))
        sums = [np.bincount(owner, minlength=len(n)).astype(np.uint64)]
        for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
            running = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)))])
            sums.append(mix(running[bounds[1:]] - running[bounds[:-1]] + sums[0]))
        nodes = np.stack(sums[1:], axis=1).astype(">u8").tobytes()
        signed = values.view(np.int64)
        tokens, shingles = [], []
        for i in range(len(n)):
            here = slice(bounds[i], bounds[i + 1])
            tokens.append(signed[here][prefix[here]] if taken[i] else None)
            shingles.append(values[here].astype("<u8").tobytes() if taken[i] else None)
        yield pa.record_batch(
            [
                part.column(0),
                part.column(1),
                pa.array(n.astype(np.int64)),
                pa.array([nodes[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()),
                pa.array(tokens, pa.list_(pa.int64())),
                pa.array(shingles, pa.binary()),
            ],
            ["doc", "mark", "n", "node", "tokens", "shingles"],
        )


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that both sides hold."""
    sides = []
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for sets in (left, right):
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, values)
        known = np.zeros(len(values), bool)
        inside = at < len(common)
        known[inside] = common[at[inside]] == values[inside]
        order = np.argsort(at[known], kind="stable")
        sides.append((at[known][order], owner[known][order]))
    total = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(common), _COLUMNS):
        blocks = []
        for (at, owner), sets in zip(sides, (left, right)):
            lo, hi = np.searchsorted(at, [begin, begin + _COLUMNS])
            block = np.zeros((len(sets), _COLUMNS), np.float32)
            block[owner[lo:hi], at[lo:hi] - begin] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total


def _group_pairs(first: list[tuple], second: list[tuple], percent: int) -> np.ndarray:
    """Which groups ``(n, prefix)`` may hold linked sets: sizes near enough, and a prefix shingle in common."""
    n, m = (np.array([g[0] for g in side]) for side in (first, second))
    near = percent * np.maximum(n[:, None], m[None, :]) <= 100 * np.minimum(n[:, None], m[None, :])
    if first is not second and near.any():
        near &= _overlaps([g[1] for g in first], [g[1] for g in second]) > 0
    return near


def _checked(rows: pa.Table, percent: int) -> pa.Table:
    """Links between the sets of two blocks, or within one, as a forest: each set beside the least it is joined to.

    Pairs of groups are filtered first; only members of groups with a partner left are compared. All sets of one block
    have the shingle in common that names it.
    """
    rows = rows.sort_by("node")
    nodes = rows["node"].to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in rows["shingles"].to_pylist()]
    second = rows["second"].to_numpy(zero_copy_only=False).astype(bool)
    group, prefixes = rows["group"].to_numpy(), rows["prefix"].to_pylist()
    sides, groups, places = [np.flatnonzero(~second), np.flatnonzero(second)], [], []
    for side in sides:
        named, place = np.unique(group[side], return_inverse=True)
        held = [None] * len(named)
        for i, at in zip(side, place):
            if prefixes[i] is not None:
                held[at] = (len(sets[i]), np.array(prefixes[i], np.int64))
        groups.append(held)
        places.append(place)
    if not len(sides[1]):
        sides, groups, places = [sides[0]] * 2, [groups[0]] * 2, [places[0]] * 2
    linked = np.zeros((len(sets), len(sets)), bool)
    if len(sides[0]):
        near = _group_pairs(*groups, percent)
        left, right = sides[0][near.any(axis=1)[places[0]]], sides[1][near.any(axis=0)[places[1]]]
        if len(left) and len(right):
            size = np.array([len(s) for s in sets])
            shared = _overlaps([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
            union = size[left][:, None] + size[right][None, :] - shared
            linked[np.ix_(left, right)] = 100 * shared >= percent * union
    linked |= linked.T
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    joined = np.flatnonzero(label != np.arange(len(sets)))
    return pa.table(
        {
            "a": pa.array([nodes[i] for i in joined], pa.binary()),
            "b": pa.array([nodes[label[i]] for i in joined], pa.binary()),
        }
    )


def _links(tiles: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Check the block pairs ``(one, two)``; every pair is one group of bounded size."""
    sides = tiles.select(
        "one", "two", F.explode(F.array_distinct(F.array(F.struct(F.col("one").alias("block"), F.lit(False).alias("second")), F.struct(F.col("two").alias("block"), (F.col("one") != F.col("two")).alias("second"))))).alias("side")
    ).select("one", "two", "side.block", "side.second")
    rows = sides.join(members.select("block", "node", "group", "prefix", "shingles"), "block").drop("block")
    return rows.groupBy("one", "two").applyInArrow(lambda table: _checked(table, percent), _LINKS)


def _near_sizes(low: str, high: str, other_low: str, other_high: str, percent: int) -> Column:
    """Whether two ranges of set sizes have sizes that linked sets may have."""
    return (percent * F.col(low) <= 100 * F.col(other_high)) & (percent * F.col(other_low) <= 100 * F.col(high))


def _blocks(found: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Members ``(node, block, group, prefix, shingles)`` and groups ``(block, group, n, prefix)``.

    ``found`` has ``(token, node, n)`` of shingles that several prefixes hold. Of these a set keeps the rarest, as many
    as must hold one that any linked set keeps too: its prefix. Sets with the same prefix and size are one group. The
    commonest shingle of the prefix names the block of a group; large blocks are dealt into several of bounded size, a
    large group into several parts. Of a group's members in a block, one carries the prefix.
    """
    counts = found.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    counts = write_stage(counts, "frequencies").df
    by_node = found.join(counts.hint("merge"), "token").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("f", "token"))).alias("tokens")
    )
    least = F.ceil(F.col("n") * percent / 100).cast("bigint")
    must = F.greatest(F.lit(1), F.floor(least / 8)).cast("int")
    by_node = by_node.withColumn("keep", F.size("tokens") - must + 1).where("keep > 0")
    by_node = by_node.withColumn("tokens", F.slice("tokens", 1, F.col("keep")))
    kept = by_node.select(
        "node", "n", F.col("tokens.token").alias("prefix"), F.element_at("tokens", -1)["token"].alias("bucket")
    ).withColumn("group", F.xxhash64("prefix", "n"))
    kept = write_stage(kept, "prefixes").df
    groups = kept.groupBy("bucket", "group", "n").agg(F.any_value("prefix").alias("prefix"), F.count("*").alias("sets"))
    groups = write_stage(groups, "groups").df
    sizes = groups.groupBy("bucket").agg(F.sum("sets").alias("all"), F.sum(F.col("n") * F.col("sets")).alias("held"))
    parts = F.greatest(F.ceil(F.col("all") / BLOCK_SETS), F.ceil(F.col("held") / BLOCK_SHINGLES))
    dealt = groups.drop("prefix").join(sizes.select("bucket", parts.alias("parts")), "bucket")
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("sets") / min(GROUP_SETS, BLOCK_SETS)))
    block = F.xxhash64("bucket", F.pmod(F.xxhash64("group", share), F.col("parts")))
    placed = kept.select("node", "bucket", "group", "n").join(dealt, ["bucket", "group", "n"])
    placed = write_stage(placed.select("node", "bucket", "group", "n", block.alias("block")), "placed").df
    leads = placed.groupBy("block", "bucket", "group", "n").agg(F.min("node").alias("node"))
    leads = write_stage(leads.join(groups.drop("sets"), ["bucket", "group", "n"]), "leads").df
    members = placed.select("node", "block", "group").join(leads.select("node", "prefix"), "node", "left")
    return members.join(nodes.select("node", "shingles"), "node"), leads.select("block", "group", "n", "prefix")


def near_copy_groups(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc, mark, n, component, chosen)`` per row: the least document of its component and whether the row is it.

    Documents are sets of distinct shingles of ``width`` words, linked from a Jaccard similarity of ``percent``
    hundredths on; a component is all that links reach.

    1. Equal sets are one node. A set's prefix is its least shingles by hash, long enough that linked sets share an
       eighth of their size in it; a count-min sketch over all prefixes lets go the sets whose prefix cannot. The more
       shingles there are beyond its bound, the more it lets through to the exact counts of step 2.
    2. Shingles of the others' prefixes are counted exactly, and each set keeps its rarest. Sets of equal prefix and size
       are collapsed into one group.
    3. Groups go into blocks by the commonest shingle kept, so that groups alike meet in one block. Blocks with a prefix
       shingle in common and sizes near enough form pairs; in a task of bounded size each, pairs of groups are filtered
       by size and prefix, expanded, and their members verified exactly and whole, which gives a forest of links instead
       of all pairs.
    4. Blocks are checked by themselves and against the least block of every shingle first. Further pairs of blocks
       are checked only where these links leave more than one component in them: what is left out joins nothing new.
    """
    rows = docs.select(
        doc_key(F.col("doc_id")).alias("doc"),
        F.coalesce(text_mark(F.col("text")), F.lit(-1).cast("bigint")).alias("mark"),
        "text",
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = sketch.cells_for(size / _PREFIX_BYTES)
    counted = sketch.estimates(rows.select("text"), lambda part: prefix_keys(part, width, percent), cells)
    shared = docs.sparkSession.sparkContext.broadcast(counted)
    sets = write_stage(
        rows.mapInArrow(lambda batches: _sets(batches, width, percent, shared.value), _SETS), "sets"
    ).df

    near = sets.where("tokens IS NOT NULL")
    classes = near.groupBy("node").agg(F.min(F.struct("doc", "mark")).alias("least"))
    classes = write_stage(classes.select("node", "least.doc", "least.mark"), "classes").df
    # One row of each class stands for it; rows that repeat an id and text are equal in all that is read here.
    nodes = near.join(classes, ["node", "doc", "mark"], "left_semi").dropDuplicates(["node"])
    nodes = write_stage(nodes.select("node", "n", "tokens", "shingles"), "nodes").df
    members, groups = _blocks(nodes.select("node", "n", F.explode("tokens").alias("token")), nodes, percent)
    members = write_stage(members, "blocks").df

    held = groups.select(F.explode("prefix").alias("token"), "block", "n").groupBy("token", "block")
    held = write_stage(held.agg(F.min("n").alias("low"), F.max("n").alias("high")), "held").df
    pivot = held.groupBy("token").agg(F.min(F.struct("block", "low", "high")).alias("one"), F.count("*").alias("blocks"))
    pivot = pivot.select("token", "blocks", F.col("one.block").alias("one"), F.col("one.low").alias("low_one"), F.col("one.high").alias("high_one"))
    star = held.join(pivot.where("blocks > 1"), "token").where(_near_sizes("low", "high", "low_one", "high_one", percent))
    star = star.select("one", F.col("block").alias("two"))
    own = members.groupBy("block").count().where("count > 1").select(F.col("block").alias("one"), F.col("block").alias("two"))
    tiles = write_stage(star.where("one <> two").unionByName(own).distinct(), "tiles").df
    links = write_stage(_links(tiles, members, percent), "found").df

    joined = components(links)
    rooted = members.select("node", "block").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = rooted.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    state = state.select("block", F.when(F.col("low") == F.col("high"), F.col("low")).alias("root"))
    marked = held.join(state, "block")
    # Only shingles whose blocks are not all in one component can join something new.
    open_tokens = marked.groupBy("token").agg(
        F.count("*").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("root").alias("whole")
    )
    open_tokens = open_tokens.where("blocks > 1 AND (whole < blocks OR low <> high)").select("token")
    marked = write_stage(marked.join(open_tokens, "token"), "open").df
    left, right = (
        marked.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "root", "low", "high")])
        for side in ("one", "two")
    )
    left, right = left.withColumnRenamed("block_one", "one"), right.withColumnRenamed("block_two", "two")
    more = left.join(right.hint("merge"), "token").where(
        "one < two AND (root_one IS NULL OR root_two IS NULL OR root_one <> root_two)"
    )
    more = more.where(_near_sizes("low_one", "high_one", "low_two", "high_two", percent))
    more = more.select("one", "two").distinct().join(tiles, ["one", "two"], "left_anti")
    both = links.unionByName(_links(write_stage(more, "tiles").df, members, percent))
    joined = components(both)

    named = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = write_stage(named, "rooted").df
    # Written, so that both sides of the join are plain exchanges and a component of very many nodes can be split.
    least = write_stage(named.groupBy("root").agg(F.min(F.struct("doc", "mark")).alias("least")), "least").df
    named = named.select("node", "root").join(least.hint("merge"), "root").select(
        "node", F.col("least.doc").alias("component"), F.col("least.mark").alias("component_mark")
    )
    named = write_stage(named, "components").df
    placed = sets.select("doc", "mark", "n", F.when(F.col("tokens").isNotNull(), F.col("node")).alias("node"))
    placed = placed.join(named.hint("merge"), "node", "left")
    chosen = F.col("component").isNull() | ((F.col("component") == F.col("doc")) & (F.col("component_mark") == F.col("mark")))
    return placed.select("doc", "mark", "n", F.coalesce("component", "doc").alias("component"), chosen.alias("chosen"))


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every document; see ``near_copy_groups``.

    Null texts and texts without words have no shingles and are linked with nothing; a text of fewer than ``width``
    words is one shingle. A null id is smaller than any other, as id and as component. Rows that repeat an id are
    documents of their own; no rows give no rows; other columns are ignored. Jobs run while the result is planned.
    """
    null = F.lit(None).cast("bigint")
    found = near_copy_groups(docs, width, percent)
    from_key = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).otherwise(null)
    return found.select(
        from_key("doc").alias("doc_id"), F.col("n").alias("n_shingles"), from_key("component").alias("component_id")
    )


def without_near_copies(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with their own columns, less all but the first of every component.

    The first is the one with the least id. Rows that repeat an id and text are one document, of which one row stays.
    """
    found = write_stage(near_copy_groups(docs, width, percent), "near").df
    gone = found.where("NOT chosen").select("doc", "mark").distinct()
    repeated = found.groupBy("doc", "mark").count().where("count > 1")
    mark = F.coalesce(text_mark(F.col("text")), F.lit(-1).cast("bigint"))
    rows = docs.select(F.struct("*").alias("document"), doc_key(F.col("doc_id")).alias("doc"), mark.alias("mark"))
    kept = rows.join(gone, ["doc", "mark"], "left_anti")
    if repeated.head():
        again = kept.join(repeated.select("doc", "mark"), ["doc", "mark"], "left_semi")
        once = kept.join(repeated.select("doc", "mark"), ["doc", "mark"], "left_anti")
        kept = once.unionByName(again.groupBy("doc", "mark").agg(F.first("document").alias("document")).select("document", "doc", "mark"))
    return kept.select(*[F.col("document")[name].alias(name) for name in docs.columns])
