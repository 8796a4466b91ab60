"""Removal of long passages that an earlier document holds: a count-min prefilter, then exact groups of windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm import sketch
from corpuskit.llm.words import Words, slices, split, window_mask, windows

WIDTH = 50
# Estimated number of documents from which a window is grouped after a map-side minimum instead of in one group.
HOT = 200
# Bytes of text per anchor, to size the sketch: words of six bytes, two anchors per half window and one.
_ANCHOR_BYTES = 80

_NO_ID = -(1 << 63)
_FOUND = "h1 bigint, h2 int, doc bigint, place bigint, more array<int>, hot boolean"
_KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def doc_key(doc_id: Column) -> Column:
    """An id to compare by; null comes before all."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(_NO_ID))


def text_mark(text: Column) -> Column:
    """31 bits that tell the texts of rows with the same id apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 31))


def _least_of(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values, by doubling."""
    reach = 1
    while reach * 2 <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (span - reach)], values[span - reach :]) if span > reach else values


def anchors(words: Words, width: int) -> np.ndarray:
    """For every window the least hash of the half as long windows in it; equal windows have equal anchors."""
    half = max(1, width // 2)
    return _least_of(windows(words.hashes, half), width - half + 1)


def anchor_keys(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and anchors of the texts, each once per text."""
    words = split(part.column(part.schema.get_field_index("text")))
    inside = window_mask(words.bounds, width, len(words.hashes))
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keys = anchors(words, width)[inside]
    owner = np.repeat(np.arange(len(words)), words.counts())[: len(inside)][inside]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[first], keys[first]


def _candidates(batches: Iterator[pa.RecordBatch], width: int, counted) -> Iterator[pa.RecordBatch]:
    """Windows estimated to be in two documents: 96 bits of hash, document, places in the text.

    A window that a text repeats is one row, with its further places as a list.
    """
    for part in (x for batch in batches for x in slices(batch)):
        words = split(part.column(1))
        at = np.flatnonzero(window_mask(words.bounds, width, len(words.hashes)))
        if not len(at):
            continue
        known = sketch.counted_in(counted, part)
        keys, begun = anchors(words, width), np.repeat(np.arange(len(words)), words.counts())
        changed = np.ones(len(keys), bool)
        changed[1:] = (keys[1:] != keys[:-1]) | (begun[1 : len(keys)] != begun[: len(keys) - 1])
        begun = begun[: len(keys)][changed]
        run = np.cumsum(changed) - 1
        repeated = known.is_repeated(keys[changed], begun)[run]
        at = at[repeated[at]]
        if not len(at):
            continue
        hot = known.is_hot(keys[changed], begun)[run][at]
        owner = np.searchsorted(words.bounds, at, side="right") - 1
        h1, place = windows(words.hashes, width)[at], at - words.bounds[owner]
        order = np.lexsort((place, h1, owner))
        first = np.ones(len(order), bool)
        first[1:] = (h1[order][1:] != h1[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        runs = np.append(np.flatnonzero(first), len(order))
        kept = order[runs[:-1]]
        sizes = np.diff(runs) - 1
        further = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
            pa.array(place[order[~first]].astype(np.int32)),
            mask=pa.array(sizes == 0),
        )
        marks = part.column(2).to_numpy(zero_copy_only=False)[owner[kept]]
        yield pa.record_batch(
            [
                pa.array(h1[kept].view(np.int64)),
                pa.array(windows(words.hashes, width, 1)[at[kept]].astype(np.uint32).view(np.int32)),
                pa.array(part.column(0).to_numpy(zero_copy_only=False)[owner[kept]]),
                pa.array(place[kept] + (marks << 32)),
                further,
                pa.array(hot[kept]),
            ],
            ["h1", "h2", "doc", "place", "more", "hot"],
        )


def _kept(batches: Iterator[pa.RecordBatch], width: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Counts, checksum and, on request, text of the words outside of covered windows."""
    for part in (x for batch in batches for x in slices(batch)):
        words = split(part.column(1))
        bounds, counts = words.bounds, words.counts()
        covered = part.column(2)
        edge = np.zeros(len(words.hashes) + 1, np.int64)
        starts = covered.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = starts + np.repeat(bounds[:-1], covered.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        keep = np.cumsum(edge[:-1]) == 0
        kept = np.add.reduceat(np.append(keep, False), bounds[:-1]) * (counts > 0)
        # A kept word with the byte after it, which becomes the space before the next one, but for a text's last.
        picked, last = np.flatnonzero(keep), np.zeros(len(keep), bool)
        owner = np.searchsorted(bounds, picked, side="right") - 1
        closing = np.ones(len(picked), bool)
        closing[:-1] = owner[1:] != owner[:-1]
        last[picked[closing]] = True
        ends = words.ends + ~last
        sizes = (ends - words.starts)[picked]
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        from_byte = np.repeat(words.starts[picked], sizes) + within
        data = np.append(words.data, np.uint8(32))
        out = data[np.minimum(from_byte, len(data) - 1)]
        out[(np.cumsum(sizes) - 1)[~last[picked]]] = 32
        lengths = np.bincount(owner, sizes, len(words)).astype(np.int64)
        stops = np.cumsum(lengths)
        raw = out.tobytes()
        parts = [raw[b - n : b] for b, n in zip(stops.tolist(), lengths.tolist())]
        yield pa.record_batch(
            [
                part.column(0),
                pa.array(counts.astype(np.int64)),
                pa.array((counts - kept).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()),
                pa.array([x.decode() if texts else None for x in parts], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def repeated_windows(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """``(doc, mark, starts)``: where windows begin in a text that also begin in a document with a smaller id."""
    rows = docs.select(
        doc_key(F.col("doc_id")).alias("doc"), "text", text_mark(F.col("text")).alias("mark")
    ).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, shared = sketch.prefilter(rows, lambda part: anchor_keys(part, width), size / _ANCHOR_BYTES, hot)
    found = rows.mapInArrow(lambda batches: _candidates(batches, width, shared.value), _FOUND)
    # Most windows are grouped once. Those of very many documents are reduced to their least id in every task first
    # and then joined back, which Spark can split where a window is skewed.
    group = Window.partitionBy("h1", "h2")
    usual = found.where("NOT hot").withColumn("least", F.min("doc").over(group)).where("doc > least")
    often = found.where("hot")
    least = often.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    often = often.join(least.hint("merge"), ["h1", "h2"]).where("doc > least")
    covered = usual.select("doc", "place", "more").unionByName(often.select("doc", "place", "more"))
    mark = F.shiftright("place", 32)
    start = (F.col("place") % (1 << 32)).cast("int")
    return covered.groupBy("doc", mark.alias("mark")).agg(
        F.concat(F.collect_list(start), F.flatten(F.collect_list("more"))).alias("starts")
    )


def without_repeated_passages(docs: DataFrame, width: int = WIDTH, texts: bool = True, hot: int = HOT) -> DataFrame:
    """Documents without the words of windows that begin in a document with a smaller id as well.

    Words are runs of other characters than ASCII white space. A window is ``width`` consecutive words of one text;
    windows are judged on the input, whatever is left of the other document. Returns ``doc_id, n_words, n_removed,
    kept_sha256`` and with ``texts`` also ``kept_text``: kept words joined by one space.

    A first pass counts, in a sketch merged from all tasks, in how many texts each window's anchor is: the least hash
    of the half windows in it. Equal windows have equal anchors, and the sketch never counts too low, so no repeated
    window is lost; the second pass groups the windows whose anchor may be in two texts by 96 bits of hash. Where the
    corpus has more anchors than a sketch of bounded size tells apart, those it lets through are counted exactly.

    A null text has no words; a null id is smaller than any other and its rows are equal among themselves, as rows
    that repeat an id are: neither removes from the other. Texts of fewer words stay whole. No rows give no rows; other
    columns are ignored. Jobs run while the result is planned.
    """
    covered = repeated_windows(docs, width, hot)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumns(
        {"key": doc_key(F.col("doc_id")), "row_mark": F.coalesce(text_mark(F.col("text")), F.lit(0).cast("bigint"))}
    )
    joined = rows.join(covered, (F.col("key") == F.col("doc")) & (F.col("row_mark") == F.col("mark")), "left")
    kept = joined.select("doc_id", "text", "starts").mapInArrow(lambda batches: _kept(batches, width, texts), _KEPT)
    return kept if texts else kept.drop("kept_text")
