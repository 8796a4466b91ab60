"""Column functions over arrays of token ids. All are row-wise, so they also run on streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(value) -> Column:
    return F.lit(value).cast("int")


def single_template(ids: Column, start_id: int = 1, end_id: int = 3) -> Column:
    """``[CLS] A [EOS]``; pass ``end_id=2`` for the older ``[CLS] A [SEP]``."""
    return F.concat(F.array(_int(start_id)), ids, F.array(_int(end_id)))


def pair_template(
    a: Column, b: Column, start_id: int = 1, middle_id: int = 2, end_id: int = 3, end_type: int = 0
) -> Column:
    """``[CLS] A [SEP] B [EOS]`` as a struct of ids and type ids (1 for B).

    The older layout closes with the separator, which then counts to B: ``end_id=2, end_type=1``.
    """
    ids = F.concat(F.array(_int(start_id)), a, F.array(_int(middle_id)), b, F.array(_int(end_id)))
    types = F.concat(
        F.array_repeat(_int(0), F.size(a) + 2), F.array_repeat(_int(1), F.size(b)), F.array(_int(end_type))
    )
    return F.struct(ids.alias("ids"), types.alias("type_ids"))


def truncate(ids: Column, length: int, reserved: int = 2) -> Column:
    """Cut content so that the template's ``reserved`` pieces still fit into ``length``."""
    if length < reserved:
        raise ValueError("length must leave room for the template")
    return F.slice(ids, 1, length - reserved)


def pad(ids: Column, length: int, pad_id: int) -> Column:
    """Fill up on the right to ``length``; longer arrays stay as they are."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(_int(pad_id), missing))


def segments(ids: Column, chunk: int = 512, seam: int = 5, dedup_tail: bool = False) -> Column:
    """Overlapping windows of ``chunk`` ids; the last one always ends at the last id.

    A list shorter than ``chunk`` is kept whole. ``dedup_tail`` leaves out a window that lies fully inside
    the last one, which otherwise happens for some lengths (a list of exactly ``chunk`` ids gives it twice).
    """
    if not 0 <= seam < chunk:
        raise ValueError("need 0 <= seam < chunk")
    step = chunk - seam
    length = F.size(ids)
    count = F.ceil(length / F.lit(float(step))).cast("int")
    last_start = length - chunk
    starts = F.concat(
        F.when(count > 1, F.transform(F.sequence(F.lit(0), count - 2), lambda k: k * step)).otherwise(
            F.array().cast("array<int>")
        ),
        F.array(last_start),
    )
    if dedup_tail:
        starts = F.filter(starts, lambda s, k: (s < last_start) | (k == count - 1))
    windows = F.transform(starts, lambda s: F.slice(ids, s + 1, chunk))
    return F.when(length < chunk, F.array(ids)).otherwise(windows)


def tail(ids: Column, length: int = 512) -> Column:
    """The last ``length`` ids."""
    if length < 1:
        raise ValueError("length must be at least 1")
    return F.when(F.size(ids) <= length, ids).otherwise(
        F.slice(ids, F.greatest(F.size(ids) - length, F.lit(0)) + 1, length)
    )


def adjacent_pairs(ids: Column) -> Column:
    """Each id with its successor, as an array of ``(pos, a, b)``; ``pos`` counts from 0."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ids) - 2, F.lit(0))),
        lambda i: F.struct(i.alias("pos"), F.get(ids, i).alias("a"), F.get(ids, i + 1).alias("b")),
    )
    return F.when(F.size(ids) >= 2, pairs).otherwise(F.slice(pairs, 1, 0))


def causal_inputs(ids: Column) -> Column:
    """All ids but the last."""
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def causal_labels(ids: Column) -> Column:
    """All ids but the first."""
    return F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0)))


def fingerprint(ids: Column) -> Column:
    """A flat, comparable digest of an id array."""
    return F.md5(F.array_join(ids.cast("array<string>"), ",").cast("binary"))
