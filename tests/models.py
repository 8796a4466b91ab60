"""Literal definitions the operators are compared with."""

import unicodedata
from collections import Counter


def folded(text):
    lowered = "".join(c.lower() for c in unicodedata.normalize("NFD", text))
    return "".join(c for c in lowered if unicodedata.category(c)[0] != "M")


def segments(ids, chunk, seam):
    """Window ``k`` of ``n = ceil(length / (chunk - seam))``: steps of ``chunk - seam``, but the last ends with the list."""
    length = len(ids)
    n = max(1, -(-length // (chunk - seam))) if length >= chunk else 1

    def start(k):
        return max(0, length - chunk) if k == n - 1 else k * (chunk - seam)

    return [[ids[i] for i in range(start(k), min(start(k) + chunk, length))] for k in range(n)]


def adjacent(ids):
    return [(i, ids[i], ids[i + 1]) for i in range(len(ids) - 1)]


def contexts(ids, offsets, margin):
    return [(i, [ids[i + o] for o in offsets], ids[i]) for i in range(margin, len(ids) - margin)]


def greedy(word, ids, unknown=0):
    if len(word) > 100:
        return [unknown]
    out, rest, first = [], word, True
    while rest:
        for cut in range(len(rest), 0, -1):
            piece = ("" if first else "##") + rest[:cut]
            if piece in ids:
                out.append(ids[piece])
                rest, first = rest[cut:], False
                break
        else:
            return [unknown]
    return out


def merged(pieces, a, b):
    out, i = [], 0
    while i < len(pieces):
        if i + 1 < len(pieces) and (pieces[i], pieces[i + 1]) == (a, b):
            out.append(a + b.removeprefix("##"))
            i += 2
        else:
            out.append(pieces[i])
            i += 1
    return out


def wordpiece(counts, size, specials):
    """One merge at a time: largest count, then smallest pair."""
    chars = sorted({c for w in counts for c in w})
    inner = sorted({"##" + c for w in counts for c in w[1:]})
    vocab = list(specials) + chars + inner
    words = {w: [w[0]] + ["##" + c for c in w[1:]] for w in counts}
    while len(vocab) < size:
        pairs = Counter()
        for w, pieces in words.items():
            for pair in zip(pieces, pieces[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        words = {w: merged(p, a, b) for w, p in words.items()}
        piece = a + b.removeprefix("##")
        if piece not in vocab:
            vocab.append(piece)
    return vocab
