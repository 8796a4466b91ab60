"""Licence scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.license_templates import TEMPLATES
from corpuskit.llm.words import slices, split, window_mask, windows

# Words of a fingerprint, and consecutive fingerprints of which winnowing keeps the least; templates of fewer
# fingerprints than the third number keep them all.
GRAM, WINDOW, SHORT = 3, 3, 20
# Places off the diagonal that an alignment may wander.
BAND = 12
# Share of a template's fingerprints that makes a candidate, and of its words that makes a match.
CANDIDATE, COVERAGE = 0.2, 0.8
# Words of a notice of under SHORT words that do not name the license; in longer templates only the number of a version does.
PLAIN = frozenset("a an and by cc in is its license licensed of or released software terms the this to under v version with work".split())

_MATCH, _MISS, _GAP = 2, -1, -1
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_FOUND = (
    "doc_id bigint, template string, license string, coverage double, matched int, start_word bigint, end_word bigint, "
    "start_char bigint, end_char bigint"
)


def winnowed(hashes: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """``(fingerprint, place)``: the least gram hash, the last of equals, of every ``window`` consecutive ones."""
    grams = windows(hashes, min(gram, len(hashes)))
    window = window if len(grams) >= SHORT else 1
    kept = {}
    for begin in range(max(1, len(grams) - window + 1)):
        part = grams[begin : begin + window]
        place = begin + len(part) - 1 - int(np.argmin(part[::-1]))
        kept[place] = int(grams[place])
    return [(value, place) for place, value in sorted(kept.items())]


def telling(text: str, short: bool) -> list[int]:
    """Places of the words that tell a template from its siblings."""
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    found = []
    for i, word in enumerate(words):
        number = word.isdigit() and i and (words[i - 1] in ("v", "version") or found[-1:] == [i - 1])
        if number or (short and (word not in PLAIN or words[i - 1 : i] == ["cc"])):
            found.append(i)
    return found


def told(places: Sequence[int], pairs: dict[int, int]) -> bool:
    """Whether an alignment holds the telling words, side by side where the template has them so."""
    return all(p in pairs for p in places) and all(
        pairs[b] == pairs[a] + 1 for a, b in zip(places, places[1:]) if b == a + 1
    )


class Index:
    """Templates by fingerprint."""

    def __init__(self, templates: Sequence[tuple[str, str, str]]):
        self.templates = templates
        words = split(pa.array([text for _, _, text in templates]), fold=True, breaks=_NOT_WORD)
        self.words = [words.hashes[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template has {GRAM} words at least")
        self.sizes, places, self.telling = [], defaultdict(list), []
        for number, hashes in enumerate(self.words):
            prints = winnowed(hashes)
            self.sizes.append(len(prints))
            self.telling.append(telling(templates[number][2], len(hashes) < SHORT))
            for value, place in prints:
                places[value].append((number, place))
        self.keys = np.array(sorted(places), np.uint64)
        self.postings = [places[int(k)] for k in self.keys]
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose gram is a fingerprint, and which one."""
        at = np.flatnonzero(self._maybe[(grams & np.uint64(0xFFFF)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[which] == grams[at]
        return at[same], which[same]


def align(words: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[dict[int, int], int, int]:
    """Best local alignment near a diagonal: place in ``words`` of every matched template word, the first and the last.

    Template word ``i`` may stand with word ``i + shift + d`` for ``d`` from ``-band`` to ``band``.
    """
    width = 2 * band + 1
    steps = np.arange(width)
    score = np.zeros((len(template) + 1, width), np.int64)
    equal = np.zeros((len(template) + 1, width), bool)
    for i in range(1, len(template) + 1):
        at = i - 1 + shift - band + steps
        inside = (at >= 0) & (at < len(words))
        equal[i, inside] = words[at[inside]] == template[i - 1]
        row = score[i - 1] + np.where(equal[i], _MATCH, _MISS)
        row[:-1] = np.maximum(row[:-1], score[i - 1, 1:] + _GAP)
        row = np.where(inside, np.maximum(row, 0), 0)
        # Words between two matched ones cost one each, carried along the row.
        row = np.maximum.accumulate(row - _GAP * steps) + _GAP * steps
        score[i] = np.where(inside, np.maximum(row, 0), 0)
    i, d = divmod(int(score.argmax()), width)
    pairs, first, last = {}, -1, -1
    while i > 0 and score[i, d] > 0:
        here = score[i, d]
        if here == score[i - 1, d] + (_MATCH if equal[i, d] else _MISS):
            if equal[i, d]:
                first = i - 1 + shift - band + d
                last = first if last < 0 else last
                pairs[i - 1] = first
            i -= 1
        elif d + 1 < width and here == score[i - 1, d + 1] + _GAP:
            i, d = i - 1, d + 1
        elif d and here == score[i, d - 1] + _GAP:
            d -= 1
        else:
            break
    return pairs, first, last


def chains(hits: list[tuple[int, int]], window: int) -> Iterator[list[tuple[int, int]]]:
    """Hits ``(place, at)`` of one template in chains in which both go on, the best first; every hit is in one chain.

    Words of a gram count as in an alignment, and a step off the diagonal costs as many gaps. A hit is joined to one of
    the ``window`` hits before it.
    """
    score, back = [], []
    for i, (place, at) in enumerate(hits):
        best, came = _MATCH * GRAM, -1
        for j in range(i - 1, max(-1, i - 1 - window), -1):
            over, up = place - hits[j][0], at - hits[j][1]
            if over > 0 and up > 0:
                reached = score[j] + _MATCH * min(GRAM, over, up) + _GAP * abs(over - up)
                if reached > best:
                    best, came = reached, j
        score.append(best)
        back.append(came)
    used = [False] * len(hits)
    for i in sorted(range(len(hits)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(hits[i])
            i = back[i]
        if chain:
            yield chain


def candidates(
    places: np.ndarray, which: np.ndarray, index: Index, share: float, band: int
) -> list[tuple[int, int, int]]:
    """``(template, shift, room)`` of runs of hits near one diagonal that hold enough of the template's fingerprints.

    A run ends where a place of the template comes again, or the diagonal leaves the band. ``room`` is the band, or
    half the way to the next run of the same template, so that occurrences side by side are told apart. Hits of several
    runs whose template places go on in order are one candidate more, with the band as wide as their drift.
    """
    diagonals = defaultdict(list)
    for place, key in zip(places.tolist(), which.tolist()):
        for number, at in index.postings[key]:
            diagonals[number].append((place - at, at))
    found = []
    for number, hits in diagonals.items():
        runs = [[]]
        seen = set()
        for diagonal, at in sorted(hits):
            if runs[-1] and (at in seen or diagonal - runs[-1][0] > band):
                runs.append([])
                seen = set()
            runs[-1].append(diagonal)
            seen.add(at)
        shifts = [run[len(run) // 2] for run in runs if len(run) >= max(1.0, share * index.sizes[number])]
        for i, shift in enumerate(shifts):
            near = [abs(shift - other) // 2 for other in shifts[max(0, i - 1) : i + 2] if other != shift]
            found.append((number, shift, min([band, *near])))
        if len(runs) > 1 and len(hits) >= share * index.sizes[number]:
            for chain in chains(sorted((diagonal + at, at) for diagonal, at in hits), 2 * index.sizes[number]):
                low, high = (edge(place - at for place, at in chain) for edge in (min, max))
                if high > low and len(chain) >= share * index.sizes[number]:
                    found.append((number, (low + high) // 2, (high - low + 1) // 2 + band))
    return found


def foremost(spans: dict[tuple[int, int], tuple[int, int]], index: Index) -> list:
    """Spans in order of place; of overlapping ones that with most matched words, then with most coverage, stays."""
    order = sorted(spans.items(), key=lambda s: (-s[1][0], -s[1][0] / len(index.words[s[0][0]]), s[0]))
    kept, starts, ends = {}, [], []
    for (number, first), (matched, last) in order:
        at = bisect(starts, first)
        if (not at or ends[at - 1] < first) and (at == len(starts) or starts[at] > last):
            starts.insert(at, first)
            ends.insert(at, last)
            kept[first] = ((number, first), (matched, last))
    return [kept[first] for first in starts]


def _scan(batches: Iterator[pa.RecordBatch], templates, band: int, share: float, coverage: float) -> Iterator[pa.RecordBatch]:
    index = Index(templates)
    for part in (x for batch in batches for x in slices(batch)):
        words = split(part.column(1), fold=True, breaks=_NOT_WORD)
        inside = window_mask(words.bounds, GRAM, len(words.hashes))
        grams = np.where(inside, windows(words.hashes, GRAM), np.uint64(0)) if len(inside) else np.zeros(0, np.uint64)
        at, which = index.hits(grams)
        at, which = at[inside[at]], which[inside[at]]
        owner = np.searchsorted(words.bounds, at, side="right") - 1
        rows = []
        for doc in np.unique(owner).tolist():
            lo, hi = int(words.bounds[doc]), int(words.bounds[doc + 1])
            mine = owner == doc if len(owner) < 1000 else slice(*np.searchsorted(owner, [doc, doc + 1]))
            spans = {}
            for number, shift, room in candidates(at[mine] - lo, which[mine], index, share, band):
                template = index.words[number]
                near = max(0, shift - room)
                here = words.hashes[lo + near : min(hi, lo + shift + len(template) + room + 1)]
                pairs, first, last = align(here, template, shift - near, room)
                matched = len(pairs)
                if matched >= coverage * len(template) and told(index.telling[number], pairs):
                    key = (number, first + near)
                    spans[key] = max(spans.get(key, (0, 0)), (matched, last + near))
            if spans:
                text = part.column(1)[doc].as_py().encode("utf-8", "surrogatepass")
                start_of_text = int(words.starts[lo]) - _lead(text)
            for (number, first), (matched, last) in foremost(spans, index):
                name, license_, _ = index.templates[number]
                begin = int(words.starts[lo + first]) - start_of_text
                end = int(words.ends[lo + last]) - start_of_text
                chars = [len(text[:x].decode("utf-8", "surrogatepass")) for x in (begin, end)]
                share_found = matched / len(index.words[number])
                rows.append((part.column(0)[doc].as_py(), name, license_, share_found, matched, first, last + 1, *chars))
        schema = pa.schema(
            [("doc_id", pa.int64()), ("template", pa.string()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32())]
            + [(n, pa.int64()) for n in ("start_word", "end_word", "start_char", "end_char")]
        )
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _lead(text: bytes) -> int:
    """Bytes before a text's first word."""
    return next((i for i, b in enumerate(text) if not _NOT_WORD[b]), 0)


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str, str]] = TEMPLATES,
    band: int = BAND,
    share: float = CANDIDATE,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Where documents hold licence texts: a row per document, template and place.

    Columns are ``doc_id, template, license, coverage, matched, start_word, end_word, start_char, end_char``; spans
    are half open and count from 0. Words are runs of ASCII letters and digits and of all other characters beyond
    ASCII, without case. All grams of a document are looked up among the winnowed fingerprints of ``templates``
    ``(name, license, text)``; where hits near one diagonal hold the ``share`` of a template's fingerprints, template
    and document are aligned within ``band`` of it, or of all diagonals that the hits of one copy drift through, and ``coverage`` of the template's words must match. Among
    them must be all words that name the license in a short notice (those not in ``PLAIN``) and the numbers after
    "version" in any template, without a word between them that the template has not. Of matches
    that overlap the one with most matched words is reported, so a notice that is part of a longer one is not reported
    again. A match without five words in a row as in the template, three in a template of some twenty words, has no
    fingerprint to be found by. The templates are a short list given by the caller and go to every task.

    Null, empty and foreign texts give no rows; a null id stays null; rows that repeat an id are scanned each; other
    columns are ignored. Documents stay in their partitions: nothing is shuffled.
    """
    templates = tuple(templates)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _scan(batches, templates, band, share, coverage), _FOUND)
