"""Removal of lines that an earlier line equals or nearly equals, by a join of deletion neighbourhoods."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm import sketch
from corpuskit.llm.passages import doc_key, text_mark
from corpuskit.llm.words import mix, slices
from corpuskit.session import write_stage

# Lines of fewer characters must be equal; longer ones may differ by one edit.
NEAR_CHARS = 10
# Segments of a line in the prefilter and in the exact filter: lines one edit apart agree outside of one segment.
COARSE, FINE = 2, 8
_LINE_BYTES = 80

_BASE = 0xD1342543DE82EF95
_BLANKS = " \t\n\x0b\x0c\r"

_LINES = "doc bigint, place bigint, digest binary, line string"
_KEYS = "key bigint, doc bigint, place bigint, longer boolean, segment int"
_VARIANTS = "hash bigint, spot bigint, doc bigint, place bigint, centre boolean"


@dataclass
class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were asked for."""

    up: np.ndarray
    down: np.ndarray

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


_POWERS = _Powers(np.ones(1, np.uint64), np.ones(1, np.uint64))
_VALUES: list[np.ndarray] = []


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass(frozen=True)
class Lines:
    """Lines of consecutive texts without blanks at their ends; blank lines are left out."""

    text: str
    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    number: np.ndarray

    def sizes(self) -> np.ndarray:
        return self.ends - self.starts


def lines_of(texts: list[str]) -> Lines:
    joined = "\n".join(texts)
    points = _points(joined)
    breaks = np.flatnonzero(points == 10)
    first, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(points)]])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(bounds, first, side="right") - 1
    number = np.arange(len(first)) - np.searchsorted(first, bounds[owner])
    solid = np.flatnonzero((points != 32) & ((points < 9) | (points > 13)))
    lo, hi = np.searchsorted(solid, first), np.searchsorted(solid, last)
    some = np.flatnonzero(hi > lo)
    starts, ends = solid[lo[some]], solid[hi[some] - 1] + 1
    return Lines(joined, points, starts, ends, owner[some], number[some])


def _hasher(points: np.ndarray):
    """A function from beginnings and ends to hashes of the characters between, the same wherever they stand."""
    if not _VALUES:
        _VALUES.append(mix(np.arange(0x110000, dtype=np.uint64)))
    _POWERS.reach(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_VALUES[0][points] * _POWERS.up[: len(points)], out=sums[1:])
    return lambda begin, end: (sums[end] - sums[begin]) * _POWERS.down[begin]


def segment_keys(found: Lines, segments: int, near_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, int]]:
    """``(rows, keys, longer, segment)``: hashes of lines without one segment.

    Lines of one length that differ by a substitution in a segment have that key in common, and so have a line and
    one with a character more in the segment: the latter's key as the ``longer`` one is cut to the former's segments.
    """
    between = _hasher(found.points)
    sizes = found.sizes()
    short = np.flatnonzero(sizes < near_chars)
    if len(short):
        yield short, mix(between(found.starts[short], found.ends[short]) + sizes[short].astype(np.uint64)), False, -1
    for longer in (False, True):
        rows = np.flatnonzero(sizes - longer >= near_chars)
        base = sizes[rows] - longer
        starts, ends = found.starts[rows], found.ends[rows]
        for segment in range(segments):
            lo, hi = segment * base // segments, (segment + 1) * base // segments
            before, after = between(starts, starts + lo), between(ends - (base - hi), ends)
            tag = mix((base * segments + segment).astype(np.uint64))
            yield rows, mix(before + mix(after + tag)), longer, segment


def _coarse_keys(part: pa.RecordBatch, near_chars: int) -> tuple[np.ndarray, np.ndarray]:
    found = lines_of(part.column(part.schema.get_field_index("text")).to_pylist())
    pairs = [(found.owner[rows], keys) for rows, keys, _, _ in segment_keys(found, COARSE, near_chars)]
    return np.concatenate([o for o, _ in pairs]).astype(np.int64), np.concatenate([k for _, k in pairs])


def _shared(batches: Iterator[pa.RecordBatch], near_chars: int, counted) -> Iterator[pa.RecordBatch]:
    """Lines that may have an equal or near one elsewhere, with their text."""
    for part in (x for batch in batches for x in slices(batch)):
        known = sketch.counted_in(counted, part)
        found = lines_of(part.column(2).to_pylist())
        wanted = np.zeros(len(found.starts), bool)
        for rows, keys, _, _ in segment_keys(found, COARSE, near_chars):
            wanted[rows] |= known.is_repeated(keys, found.owner[rows])
        at = np.flatnonzero(wanted)
        docs = part.column(0).to_numpy(zero_copy_only=False)[found.owner[at]]
        marks = part.column(1).to_numpy(zero_copy_only=False)[found.owner[at]]
        texts = [found.text[a:b] for a, b in zip(found.starts[at].tolist(), found.ends[at].tolist())]
        digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        yield pa.record_batch(
            [pa.array(docs), pa.array((marks << 32) + found.number[at]), pa.array(digests, pa.binary()), pa.array(texts, pa.string())],
            ["doc", "place", "digest", "line"],
        )


def _fine_keys(batches: Iterator[pa.RecordBatch], near_chars: int) -> Iterator[pa.RecordBatch]:
    for part in (x for batch in batches for x in slices(batch, "line")):
        found = lines_of(part.column(2).to_pylist())
        docs, places = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for rows, keys, longer, segment in segment_keys(found, FINE, near_chars):
            if segment >= 0 and len(rows):
                owner = found.owner[rows]
                yield pa.record_batch(
                    [
                        pa.array(keys.view(np.int64)),
                        pa.array(docs[owner]),
                        pa.array(places[owner]),
                        pa.array(np.full(len(rows), longer)),
                        pa.array(np.full(len(rows), segment, np.int32)),
                    ],
                    ["key", "doc", "place", "longer", "segment"],
                )


def deletions(line: str) -> tuple[np.ndarray, int]:
    """Hashes of the line without its first, second, ... character, and of the whole line."""
    points = _points(line).astype(np.uint64)
    place = np.arange(len(points), dtype=np.uint64) << np.uint64(21)
    before = np.concatenate([[np.uint64(0)], np.cumsum(mix(points | place))])
    moved = mix(points[1:] | place[:-1])
    after = np.concatenate([np.cumsum(moved[::-1])[::-1], [np.uint64(0)]])
    return mix(before[:-1] + after), int(mix(before[-1:])[0])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every line the variants by one deletion in its open segments, and itself.

    ``spot`` is length and deleted position for lines of equal length, where it must agree, and the length alone where
    one line has a character more; lines stand there as they are (``centre``).
    """
    for part in (x for batch in batches for x in slices(batch, "line")):
        for doc, place, line, same, longer in zip(*(part.column(i).to_pylist() for i in range(5))):
            without, whole = deletions(line)
            n = len(line)
            hashes, spots, centre = [], [], []
            for segment in same or []:
                at = np.arange(segment * n // FINE, (segment + 1) * n // FINE)
                hashes.append(without[at])
                spots.append((n << 32) + at + 1)
                centre.append(np.zeros(len(at), bool))
            for segment in longer or []:
                at = np.arange(segment * (n - 1) // FINE, (segment + 1) * (n - 1) // FINE + 1)
                at = at[np.unique(without[at], return_index=True)[1]]
                hashes.append(without[at])
                spots.append(np.full(len(at), (n - 1) << 32))
                centre.append(np.zeros(len(at), bool))
            if same:
                hashes.append(np.array([whole], np.uint64))
                spots.append(np.array([n << 32]))
                centre.append(np.ones(1, bool))
            hashes = np.concatenate(hashes)
            yield pa.record_batch(
                [
                    pa.array(hashes.view(np.int64)),
                    pa.array(np.concatenate(spots)),
                    pa.array(np.full(len(hashes), doc)),
                    pa.array(np.full(len(hashes), place)),
                    pa.array(np.concatenate(centre)),
                ],
                ["hash", "spot", "doc", "place", "centre"],
            )


def _near(distinct: DataFrame, near_chars: int) -> DataFrame:
    """``(doc, place)`` of the distinct lines, known by their first place, that an earlier one nearly equals."""
    keys = distinct.select("doc", "place", "line").mapInArrow(lambda batches: _fine_keys(batches, near_chars), _KEYS)
    keys = write_stage(keys, "keys").df
    open_keys = write_stage(keys.groupBy("key").count().where("count > 1").select("key"), "open").df
    segments = keys.join(open_keys.hint("merge"), "key").groupBy("doc", "place").agg(
        F.collect_set(F.when(~F.col("longer"), F.col("segment"))).alias("same"),
        F.collect_set(F.when(F.col("longer"), F.col("segment"))).alias("more"),
    )
    candidates = distinct.select("doc", "place", "line").join(segments, ["doc", "place"])
    candidates = write_stage(candidates.select("doc", "place", "line", "same", "more"), "candidates").df
    variants = write_stage(candidates.mapInArrow(_variants, _VARIANTS), "variants").df

    order = F.struct("doc", "place")
    groups = variants.groupBy("hash", "spot").agg(
        F.min(F.when(F.col("centre"), order)).alias("centre_line"),
        F.min(F.when(~F.col("centre"), order)).alias("other_line"),
    )
    # Lines with one deleted position in common all differ by that character alone, so the least of them will do. Of a
    # line and those with a character more, each is held against the other kind only.
    placed = F.col("spot") % (1 << 32) > 0
    against = F.when(placed | F.col("centre"), F.col("other_line")).otherwise(F.col("centre_line"))
    pairs = variants.join(groups.hint("merge"), ["hash", "spot"]).withColumn("first", against)
    pairs = pairs.where("first < struct(doc, place)").select("doc", "place", "first").distinct()
    left = candidates.select("doc", "place", "line")
    right = candidates.select(order.alias("first"), F.col("line").alias("other"))
    checked = pairs.join(left, ["doc", "place"]).join(right, "first")
    return checked.where(F.levenshtein("line", "other", 1) >= 0).select("doc", "place").distinct()


def repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``(doc, mark, gone, near)``: numbers of the lines to remove from each text, and how many have only a near match.

    A line goes when it is not the first of its kind, or when the first of its kind is one edit (a character changed,
    added or left out) from a line whose first place is earlier, whether that one stays or not. Places are in order of
    document id, then text, then line; blanks at the ends of a line do not count, and blank lines stay. Lines of fewer
    than ``near_chars`` characters, or one edit from such, must be equal.
    """
    rows = docs.select(
        doc_key(F.col("doc_id")).alias("doc"), text_mark(F.col("text")).alias("mark"), "text"
    ).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, shared = sketch.prefilter(rows, lambda part: _coarse_keys(part, near_chars), size / _LINE_BYTES)
    found = write_stage(
        rows.mapInArrow(lambda batches: _shared(batches, near_chars, shared.value), _LINES), "lines"
    ).df
    first = found.groupBy("digest").agg(F.min(F.struct("doc", "place")).alias("first"))
    first = write_stage(first.select("digest", "first.doc", "first.place"), "first").df
    # A place is one row, but for rows that repeat an id and a text.
    distinct = found.join(first, ["digest", "doc", "place"], "left_semi").dropDuplicates(["doc", "place"])
    near = write_stage(_near(distinct, near_chars).withColumn("near", F.lit(True)), "near").df
    decided = first.join(near, ["doc", "place"], "left").select(
        "digest", F.struct("doc", "place").alias("first"), F.coalesce("near", F.lit(False)).alias("near")
    )
    decided = write_stage(decided, "decided").df
    again = F.col("first") != F.struct("doc", "place")
    gone = found.select("digest", "doc", "place").join(decided.hint("merge"), "digest").where(again | F.col("near"))
    gone = gone.select("doc", "place", (F.col("near") & ~again).alias("near")).distinct()
    mark = F.shiftright("place", 32)
    return gone.groupBy("doc", mark.alias("mark")).agg(
        F.collect_list((F.col("place") % (1 << 32)).cast("int")).alias("gone"),
        F.sum(F.col("near").cast("bigint")).alias("near"),
    )


def _with_lines(docs: DataFrame, near_chars: int) -> DataFrame:
    """Documents as one column beside their lines, the numbers of those that stay, and counts."""
    gone = repeated_lines(docs, near_chars)
    rows = docs.select(
        F.struct("*").alias("document"),
        doc_key(F.col("doc_id")).alias("doc"),
        F.coalesce(text_mark(F.col("text")), F.lit(-1).cast("bigint")).alias("mark"),
    )
    all_lines = F.split("document.text", "\n")
    joined = rows.join(gone, ["doc", "mark"], "left").withColumn("lines", all_lines)
    none = F.array().cast("array<int>")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", none))
    return joined.withColumn("stay", F.when(F.col("lines").isNotNull(), stay))


def _text() -> Column:
    whole = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    return F.when(F.col("gone").isNull(), F.col("document.text")).otherwise(whole)


def line_report(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, n_near, kept_sha256)`` for every document; see ``repeated_lines``.

    ``n_near`` counts the removed lines that are the first of their kind. A null text has no lines and null as
    checksum, an empty one has one blank line. A null id is smaller than any other. Rows that repeat an id and a text
    have equal results, and lines are not repeated between them; rows that repeat an id alone are documents of their
    own. No rows give no rows; other columns are ignored. Jobs run while the result is planned.
    """
    found = _with_lines(docs, near_chars)
    return found.select(
        F.col("document.doc_id").alias("doc_id"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"),
        F.sha2(_text().cast("binary"), 256).alias("kept_sha256"),
    )


def without_repeated_lines(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents, with their own columns, whose text keeps the lines that stay; see ``repeated_lines``.

    Documents that lose lines and keep no line but blank ones go. ``n_chars``, where there is such a column, is the
    length of the new text.
    """
    found = _with_lines(docs, near_chars).withColumn("text", _text())
    emptied = F.col("gone").isNotNull() & (F.length(F.translate("text", _BLANKS, "")) == 0)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            length = F.char_length("text").cast(docs.schema[name].dataType)
            columns.append(F.when(F.col("gone").isNull(), F.col("document.n_chars")).otherwise(length).alias(name))
        else:
            columns.append(F.col("document")[name].alias(name))
    return found.where(~emptied).select(*columns)


# The same as line_report in DuckDB, for rows with distinct ids.
LINES_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
o AS MATERIALIZED (
  SELECT doc_id, i, trim(ls[i + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM d)),
f AS MATERIALIZED (
  SELECT line, length(line) AS n, min((doc_id, i)) AS first FROM o WHERE line <> '' GROUP BY line),
k AS (
  SELECT line, first, n AS l, 'a' || line[1:n // 2] AS k FROM f WHERE n >= {NEAR_CHARS}
  UNION ALL SELECT line, first, n, 'b' || line[n // 2 + 1:n] FROM f WHERE n >= {NEAR_CHARS}
  UNION ALL SELECT line, first, n - 1, 'a' || line[1:(n - 1) // 2] FROM f WHERE n > {NEAR_CHARS}
  UNION ALL SELECT line, first, n - 1, 'b' || line[(n - 1) // 2 + 2:n] FROM f WHERE n > {NEAR_CHARS}),
e AS (
  SELECT DISTINCT x.line FROM k x JOIN k y ON x.l = y.l AND x.k = y.k AND y.first < x.first
  WHERE abs(length(x.line) - length(y.line)) <= 1 AND least(length(x.line), length(y.line)) >= {NEAR_CHARS}
    AND levenshtein(x.line, y.line) <= 1),
g AS (SELECT o.doc_id, o.i, (o.doc_id, o.i) <> f.first AS again, e.line IS NOT NULL AS near
      FROM o JOIN f ON f.line = o.line LEFT JOIN e ON e.line = o.line),
r AS (SELECT doc_id, list(i) AS gone, count(*) AS n, count(*) FILTER (WHERE NOT again) AS near
      FROM g WHERE again OR near GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed,
       coalesce(r.near, 0)::BIGINT AS n_near,
       sha256(array_to_string(list_filter(ls, lambda x, i: gone IS NULL OR NOT list_contains(gone, i - 1)), chr(10)))
         AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
