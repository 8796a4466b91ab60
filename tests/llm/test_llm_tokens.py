import hashlib
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from corpuskit.llm import alignment, chunks, packing, token_files
from corpuskit.llm.elias_fano import EliasFano
from corpuskit.session import scratch_path

SF = "/root/testdata/sf0.001"

ODD_TEXTS = [
    None,
    "",
    " ",
    "  ",
    "a ",
    "a  ",
    " a",
    "a  b  c\n\n d\t e \n",
    "special <|endoftext|> and<|startoftext|>, <s> <unk> </s> <0x41>",
    "▁ a▁b",
    "日本語のテキスト　です。 𐍈𐍈 😁👩‍👩‍👧 é ́x",
    "it's WE'LL don't  O'Neil's 12345 --- ???!",
    "x" * 5000,
    "nul \x00 and \x1c \x85   marks",
    "ÀÉÎ straße İstanbul Σίσυφος ς",
    "long " + "word " * 3000,
]


def odd_documents(spark):
    rows = list(enumerate(ODD_TEXTS, 100)) + [(None, "no id"), (None, None), (100, "twice"), (101, ""), (-7, "below")]
    return rows, brute.documents(spark, rows)


def whole_table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Elias-Fano


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=200))
def test_select_gives_every_value(values):
    values = sorted(values)
    built = EliasFano.build(np.array(values, np.uint64))
    read, end = EliasFano.from_bytes(b"xx" + built.to_bytes() + b"yy", 2)
    assert end == 2 + len(built.to_bytes())
    assert read.select(np.arange(len(values))).tolist() == values


def test_boundaries_take_little_room():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 2000, 50_000)).astype(np.uint64)
    built = EliasFano.build(ends)
    # Beside the low bits two to three bits for each, 32 for every 512 of those, and rounding.
    assert len(built.to_bytes()) * 8 / len(ends) < built.low_bits + 3 * (1 + 1 / 16) + 0.1
    at = np.random.default_rng(3).permutation(50_000)[:1000]
    assert (built.select(at) == ends[at]).all()
    for at in ([-1], [50_000]):
        with pytest.raises(IndexError):
            built.select(np.array(at))
    with pytest.raises(ValueError):
        EliasFano.build(np.array([2, 1], np.uint64))


# Chunks


def encoders():
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [lambda t, k=k: k.encode(t, add_special_tokens=False).ids for k in (word, byte)], (
        (token_files.VOCABULARY, chunks.WORD_LEVEL),
        (packing.VOCABULARY, chunks.BYTE_LEVEL),
    )


def test_chunks_encode_as_whole_texts(spark):
    texts = [t for t in ODD_TEXTS if t] + [r.text for r in whole_table(spark).collect()]
    for slow, (vocabulary, cuts) in zip(*encoders()):
        for cut in (cuts, None):
            ids, bounds = chunks.encoded(pa.array(texts, pa.string()), token_files.chunk_memory(vocabulary), cut)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [slow(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '1.\n\t  　é日😁s<|endoftext|>"), max_size=30), max_size=4))
def test_chunks_of_any_text(texts):
    for slow, memory, cuts in _MEMORIES:
        for cut in (cuts, None):
            ids, bounds = chunks.encoded(pa.array(texts, pa.string()), memory, cut)
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [slow(t) for t in texts]


_MEMORIES = [(slow, token_files.chunk_memory(v), cuts) for slow, (v, cuts) in zip(*encoders())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab '12.\n\t é😁", "'s", "<|endoftext|>", "the", "\u0301", "z" * 401]), max_size=20).map("".join))
def test_packing_ids_are_those_of_the_plain_call(text):
    assert _ENCODER.ids(text).tolist() == _PLAIN.encode(text, add_special_tokens=False).ids


_ENCODER, _PLAIN = packing.Encoder(), Tokenizer.from_file(packing.VOCABULARY)


def test_packed_pieces_have_the_ids_of_the_plain_call(spark):
    rows, docs = odd_documents(spark)
    wanted = Counter()
    for doc_id, text in rows:
        ids = np.array(_PLAIN.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        points = packing.cut_points(len(ids), 64)
        for piece, (a, b) in enumerate(zip(points, points[1:])):
            wanted[doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    found = packing.pack_documents(docs, length=64).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted


def test_a_small_memory_gives_the_same_values():
    asked = [b"%d" % (i * i % 37) for i in range(300)]
    memory = chunks.Memory(lambda texts: [t * 2 for t in texts], most=4)
    assert [memory.values(asked[i : i + 7]) for i in range(0, 300, 7)] == [
        [(c * 2).decode() for c in asked[i : i + 7]] for i in range(0, 300, 7)
    ]
    assert len(memory._young) + len(memory._old) <= 16


# Token files


def plain_report(rows):
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    found, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        found.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


def test_token_files_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in whole_table(spark).collect()]
    found = token_files.token_report(whole_table(spark), file_ids=3000, task_bytes=1 << 15)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 4
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain_report(rows))


def test_token_files_of_odd_rows(spark):
    rows, docs = odd_documents(spark)
    rows = rows[:-2] + [(140, "copy " * 9)] * 200 + rows[-2:]
    docs = brute.documents(spark, rows)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, path, file_ids=50, task_bytes=500)
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, path).collect())
    wanted = plain_report(rows)
    assert [r[1] for r in found] == [r[0] for r in wanted]
    # Rows that repeat an id stand in any order of their own.
    assert Counter(r[1:] for r in found) == Counter((d, n, c) for d, _, n, c in wanted)
    assert all(a[0] + a[2] == b[0] for a, b in zip(found, found[1:]))

    for row in token_files.manifest(spark, path).collect():
        reader = token_files.TokenReader.open(f"{path}/data", row.name)
        for place in {0, reader.docs // 2, reader.docs - 1}:
            doc_id, ids = reader.document(place)
            start, at_id, n, crc = found[row.first_doc + place]
            assert (doc_id, row.start + int(reader.offsets(place, place + 1)[0]), len(ids)) == (at_id, start, n)
            assert zlib.crc32(ids.tobytes()) == crc


def test_files_that_the_manifest_does_not_name_are_no_data(spark):
    path = scratch_path(spark, "tokens")
    docs = brute.documents(spark, [(1, "one"), (2, "two")])
    token_files.write_tokens(docs, path)
    stray = token_files.TokenWriter(f"{path}/data", "part-000000-99", 2)
    stray.add(1, np.array([5, 6, 2]))
    stray.close()
    assert sorted(r.doc_id for r in token_files.read_tokens(spark, path).collect()) == [1, 2]


def test_wide_ids_and_no_rows(spark, tmp_path):
    writer = token_files.TokenWriter(str(tmp_path), "w", 4)
    writer.add(None, np.array([], "<u4"))
    writer.add(-(2**63), np.array([70_000], "<u4"))
    writer.add(2**63 - 1, np.array([1, 2**32 - 1], "<u4"))
    writer.close()
    reader = token_files.TokenReader.open(str(tmp_path), "w-0")
    assert [(d, ids.tolist()) for d, ids in map(reader.document, range(3))] == [
        (None, []), (-(2**63), [70_000]), (2**63 - 1, [1, 2**32 - 1]),
    ]
    assert token_files.token_report(whole_table(spark).limit(0)).count() == 0


# Alignment


def plain_alignment(rows):
    """Whole texts, token bytes and ends as the definition has them."""
    a_side = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=alignment.PIECES)
    letters = alignment.byte_alphabet()
    links, shown, sizes = [], [], []
    for _, text in rows:
        links.append([])
        shown.append("")
        sizes.append((0, 0, 0))
        if not text:
            continue
        raw = (" " + text).encode()
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, b_side.id_to_piece(i)) for i in b)
        ]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        j = 0
        for i, end in enumerate(a_ends):
            begin = a_ends[i - 1] if i else 0
            while b_ends[j] <= begin:
                j += 1
            at = j
            while at < len(b) and (b_ends[at - 1] if at else 0) < end:
                links[-1].append((a[i], b[at]))
                at += 1
        common = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for end in common:
            k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        shown[-1] = hashlib.sha256(";".join(groups).encode()).hexdigest()
        sizes[-1] = (len(a), len(b), len(groups))
    counts = Counter(p for one in links for p in one)
    top = defaultdict(int)
    for (_, second), n in counts.items():
        top[second] = max(top[second], n)
    return Counter(
        (d, *size, len(one), sum(counts[p] == top[p[1]] for p in one), sum(counts[p] for p in one), sha)
        for (d, _), size, one, sha in zip(rows, sizes, links, shown)
    )


@pytest.mark.parametrize("hot", [0, 200, 1 << 18])
def test_alignment_matches_brute_force(spark, hot):
    rows, docs = odd_documents(spark)
    found = alignment.aligned(docs, hot_pairs=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 7 + ["string"]
    assert Counter(tuple(r) for r in found.collect()) == plain_alignment(rows)


def test_alignment_of_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in whole_table(spark).collect()]
    assert Counter(tuple(r) for r in alignment.aligned(whole_table(spark)).collect()) == plain_alignment(rows)
    assert alignment.aligned(whole_table(spark).limit(0)).count() == 0


def test_chunks_are_aligned_alike_alone_and_together():
    aligner = alignment.Aligner()
    assert aligner.separable
    texts = [" plain words", " é€ 😁𐍈𐍈", " 日本語 x", " ▁", " a\n", " b", "  c", " \x00z", " ▁ y"]
    together = aligner.values(texts)
    assert together == [aligner.values([t])[0] for t in texts] and [v is False for v in together].count(True) == 2
    for text, value in zip(texts, together):
        if value:
            groups = [[list(map(int, side.split(","))) for side in g.split("|")] for g in value.shown.split(";")]
            assert [i for a, _ in groups for i in a] == aligner._first.encode(text, add_special_tokens=False).ids
            assert [i for _, b in groups for i in b] == aligner._second.encode(text[1:])
            for a, b in groups:
                assert b"".join(aligner.first_bytes[i] for i in a) == b"".join(aligner.second_bytes[i] for i in b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=8))
def test_links_are_overlaps(a, b):
    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    a_ends, b_ends = np.cumsum(a), np.cumsum(b)
    i, j, _, common = alignment.links_of(a_ends, b_ends)
    over = [
        (i, j)
        for i in range(len(a))
        for j in range(len(b))
        if max(a_ends[i] - a[i], b_ends[j] - b[j]) < min(a_ends[i], b_ends[j])
    ]
    assert list(zip(i.tolist(), j.tolist())) == over and common.sum() == len(set(a_ends.tolist()) & set(b_ends.tolist()))


def test_spans_that_share_a_character_end_by_decoded_bytes():
    # One character of three bytes in three tokens, each with the whole character as its span, and a letter.
    starts, ends, sizes = np.array([0, 0, 0, 3]), np.array([3, 3, 3, 4]), np.array([1, 1, 1, 1])
    assert alignment.token_ends(starts, ends, sizes).tolist() == [1, 2, 3, 4]
