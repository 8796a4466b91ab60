"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns of the user's own with names that plans like to use.
CLASH = "doc string, mark string, size string, node string, row string, place string, id string, n string"


def documents(spark, rows, clash=True):
    """Documents from ``(doc_id, text[, lang[, source]])`` with columns of clashing names beside."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *("en", "s0")[len(row) - 2 :])[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text)) + (("x",) * 8 if clash else ()))
    return spark.createDataFrame(full, f"{SCHEMA}, {CLASH}" if clash else SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, width=5):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def passages(docs, width=50):
    first = {}
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    for d in sorted(docs):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def kept_lines(docs, least=10):
    """``{doc: (kept lines, removed, near)}`` for texts by distinct ids."""
    first = {}
    for d in sorted(docs):
        for i, line in enumerate((docs[d] or "").split("\n")):
            line = line.strip(BLANKS)
            if line:
                first.setdefault(line, (d, i))
    near = {
        a
        for a in first
        if any(b != a and first[b] < first[a] and min(len(a), len(b)) >= least and one_edit(a, b) for b in first)
    }
    out = {}
    for d, text in docs.items():
        kept, removed, by_near = [], 0, 0
        for i, raw in enumerate(text.split("\n") if text is not None else []):
            line = raw.strip(BLANKS)
            if line and (first[line] != (d, i) or line in near):
                removed += 1
                by_near += first[line] == (d, i)
            else:
                kept.append(raw)
        out[d] = (kept, removed, by_near)
    return out


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, capped, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = set(), sum(sizes.values())
    while True:
        rest = left - sum(cap * sizes[s] for s in capped)
        whole = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and rest * weight[s] > cap * sizes[s] * whole}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else rest * weight[s] / whole for s in order}
        capped |= over


def phrases(text, sample):
    """Phrases of the greedy parse of a list of symbols into substrings of the sample (symbol 0 matches nothing)."""
    count, i = 0, 0
    while i < len(text):
        n = 0
        while i + n < len(text) and text[i + n] and contains(sample, text[i : i + n + 1]):
            n += 1
        count, i = count + 1, i + max(n, 1)
    return count


def contains(sample, part):
    return any(sample[j : j + len(part)] == part for j in range(len(sample) - len(part) + 1))


def local_matches(words, template):
    """Most matched words of the best local alignment without a band (match 2, mismatch and gap -1)."""
    table = defaultdict(lambda: (0, 0))
    best = (0, 0)
    for i, t in enumerate(template):
        for j, w in enumerate(words):
            up, left, diagonal = table[i - 1, j], table[i, j - 1], table[i - 1, j - 1]
            options = [(0, 0), (up[0] - 1, up[1]), (left[0] - 1, left[1])]
            options.append((diagonal[0] + 2, diagonal[1] + 1) if t == w else (diagonal[0] - 1, diagonal[1]))
            table[i, j] = max(options)
            best = max(best, table[i, j])
    return best[1]
