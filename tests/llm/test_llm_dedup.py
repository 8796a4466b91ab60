import random

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpuskit.llm import components, lines, overlap, passages, queries, sketch, words

ABC = [f"w{i}" for i in range(400)]


def text_of(rng, n, vocabulary=ABC):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("fold", [False, True])
def test_word_hashes_tell_words_apart(fold):
    texts = ["Aa b\tb  Aa", "", None, "\n", "b", "é É A", "x" * 3000 + " b"]
    found = words.split(pa.array(texts), fold)
    split = [brute.WORD.findall(brute.lower(t) if fold else t) if t else [] for t in texts]
    assert found.counts().tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    ids = found.hashes.tolist()
    assert all((ids[i] == ids[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


@pytest.mark.parametrize("width", [1, 2, 5, 50])
def test_window_hashes_tell_windows_apart(width):
    rng = random.Random(width)
    flat = [rng.choice("ab") for _ in range(width + 60)]
    hashes = words.split(pa.array([" ".join(flat)])).hashes
    found = words.windows(hashes, width)
    parts = [tuple(flat[i : i + width]) for i in range(len(flat) - width + 1)]
    assert len(found) == len(parts) and len(set(found.tolist())) == len(set(parts))


def test_sketch_never_counts_too_low(spark):
    keys = np.random.default_rng(1).integers(0, 3000, 5000)
    df = spark.createDataFrame([(str(k),) for k in keys], "text string").repartition(5)

    def keys_of(part):
        return np.arange(part.num_rows), words.mix(np.array(part.column(0).to_pylist(), np.uint64))

    found = sketch.estimates(df, keys_of, 1 << 16, 3)
    held, counts = np.unique(keys, return_counts=True)
    hashed = words.mix(held.astype(np.uint64))
    assert found.is_repeated(hashed)[counts >= 2].all() and found.is_hot(hashed)[counts >= 3].all()
    assert found.is_repeated(hashed)[counts == 1].mean() < 0.1


@pytest.fixture
def small_sketch(request, monkeypatch):
    """With True as parameter, any input has more keys than a sketch is said to tell apart."""
    if request.param:
        monkeypatch.setattr(sketch, "MOST_CELLS", 1 << 16)
        monkeypatch.setattr(sketch, "CELLS_PER_KEY", 1 << 40)


either_way = pytest.mark.parametrize("small_sketch", [False, True], indirect=True)


@pytest.mark.parametrize("small_sketch", [True], indirect=True)
def test_keys_beyond_the_sketch_are_counted_exactly(spark, small_sketch):
    # 300,000 keys in 65,536 cells: the sketch lets nearly all of them through.
    texts = {(i, 0): str(i) for i in range(100)} | {(200, 0): "7", (200, 1): "8", (201, 0): "7", (300, 0): None}
    rows = spark.createDataFrame([(d, m, t) for (d, m), t in texts.items()], "doc bigint, mark bigint, text string")

    def keys_of(part):
        numbers = np.array([int(t or 0) for t in part.column(part.schema.get_field_index("text")).to_pylist()], np.uint64)
        some = np.arange(3000, dtype=np.uint64)
        return np.repeat(np.arange(len(numbers)), 3000), words.mix((numbers[:, None] * np.uint64(5000) + some).ravel())

    found, counted = sketch.prefilter(rows.repartition(4), keys_of, 1000, 3)
    assert counted.value is None and found.columns == ["doc", "mark", "text", "open", "often"]
    got = {(r.doc, r.mark): (len(r.open or []), len(r.often or [])) for r in found.collect()}
    want = {k: (3000 if t in ("7", "8", "0", None) else 0, 3000 if t == "7" else 0) for k, t in texts.items()}
    assert got == want


def passage_documents(seed=5):
    rng = random.Random(seed)
    shared = [text_of(rng, n) for n in (49, 50, 51, 120)]
    docs = {i: text_of(rng, rng.randint(0, 90)) for i in range(40)}
    for i in range(0, 40, 3):
        docs[i] = f"{docs[i]}\n{rng.choice(shared)} \t{text_of(rng, 5)}"
    docs[50], docs[51] = "a " * 300, "a " * 120
    docs[52] = docs[53] = docs[3]
    docs[54], docs[55], docs[56] = None, "", " \n\t"
    docs[57] = " ".join(["é", "ß"] * 40)
    docs[58] = "x " + docs[57]
    docs[-5] = shared[3]
    return docs


@either_way
@pytest.mark.parametrize("hot", [2, 200])
def test_passages_match_brute_force(spark, hot, small_sketch):
    docs = passage_documents()
    df = brute.documents(spark, list(docs.items())).repartition(3)
    found = passages.without_repeated_passages(df, hot=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute.passages(docs)
    assert {r.doc_id: r.kept_text for r in found}[51] == ""


def test_passages_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    a, b = text_of(rng, 80), text_of(rng, 80)
    rows = [(None, a), (None, a), (1, a), (1, b), (1, b), (2, b + " tail")]
    found = passages.without_repeated_passages(brute.documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in found) == [
        (-1, 80, 0), (-1, 80, 0), (1, 80, 0), (1, 80, 0), (1, 80, 80), (2, 81, 80),
    ]


@pytest.mark.parametrize(
    "operator",
    [passages.without_repeated_passages, lines.line_report, lines.without_repeated_lines, overlap.jaccard_components, overlap.without_near_copies],
)
@either_way
def test_no_rows_and_nothing_but_empty_rows(spark, operator, small_sketch):
    assert operator(brute.documents(spark, [])).count() == 0
    assert operator(brute.documents(spark, [(1, None), (None, ""), (2, " ")])).count() == 3


def near_documents(seed=11):
    rng = random.Random(seed)
    docs = {}
    for base in range(8):
        source = text_of(rng, rng.choice([4, 5, 30, 200])).split()
        for copy in range(rng.randint(1, 9)):
            mine = list(source)
            for _ in range(copy):
                mine[rng.randrange(len(mine))] = rng.choice(ABC)
            docs[base * 20 + copy] = " ".join(mine).upper() if copy % 3 == 2 else " ".join(mine)
    docs |= {500: "one two", 501: "One\ttwo", 502: "one", 503: None, 504: "", 505: " \n"}
    common = text_of(rng, 12)
    docs |= {600 + i: f"{common} {text_of(rng, 3)}" for i in range(30)}
    docs |= {700 + i: text_of(rng, 400, ["x", "y"]) for i in range(6)}
    return docs


@either_way
@pytest.mark.parametrize("block", [2, 256])
def test_components_match_brute_force(spark, monkeypatch, block, small_sketch):
    monkeypatch.setattr(overlap, "BLOCK_SETS", block)
    docs = near_documents()
    df = brute.documents(spark, list(docs.items())).repartition(3)
    found = overlap.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.components(docs)
    kept = overlap.without_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in brute.components(docs).items() if c == d)


def test_near_copies_of_null_and_repeated_ids(spark):
    same, other = "a b c d e f g", "p q r s t u v"
    rows = [(7, same), (7, same), (7, other), (None, other), (9, same), (9, None), (9, None)]
    found = overlap.jaccard_components(brute.documents(spark, rows)).collect()
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in found)
    assert got == [(-1, 3, -1), (7, 3, -1), (7, 3, 7), (7, 3, 7), (9, 0, 9), (9, 0, 9), (9, 3, 7)]
    kept = overlap.without_near_copies(brute.documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, other), (7, same), (9, "")]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99)], "a int, b int")
    found = {r.node: r.root for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 99}


def line_documents(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé ") for _ in range(n)).strip() + "." for n in (8, 9, 10, 11, 25, 60) for _ in range(3)]
    docs = {}
    for d in range(40):
        mine = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(base)
            at = rng.randrange(len(line))
            kind = rng.randint(0, 5)
            if kind == 0:
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            elif kind == 1:
                line = line[:at] + line[at + 1 :]
            elif kind == 2:
                line = line[:at] + rng.choice("xb") + line[at:]
            mine.append(rng.choice(["", "", " ", "\t"]) + line + rng.choice(["", "\r"]))
        docs[d] = "\n".join(mine)
    docs |= {90: None, 91: "", 92: "\n \n", 93: "aaaaaaaaaaaa\naaaaaaaaaaaaa", 94: "z" * 20000, 95: "z" * 20001}
    return docs


@either_way
def test_lines_match_brute_force(spark, small_sketch):
    docs = line_documents()
    df = brute.documents(spark, list(docs.items())).repartition(3)
    truth = brute.kept_lines(docs)
    assert sum(near for _, _, near in truth.values()) > 10
    found = {r.doc_id: r for r in lines.line_report(df).collect()}
    assert {d: (r.n_lines, r.n_removed, r.n_near) for d, r in found.items()} == {
        d: (len(kept) + gone, gone, near) for d, (kept, gone, near) in truth.items()
    }
    kept = lines.without_repeated_lines(df)
    assert kept.columns == df.columns
    texts = {d: "\n".join(k) if docs[d] is not None else None for d, (k, gone, _) in truth.items()}
    gone = {d for d, (k, n, _) in truth.items() if n and not "".join(k).strip(brute.BLANKS)}
    assert {r.doc_id: r.text for r in kept.collect()} == {d: t for d, t in texts.items() if d not in gone}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.collect())


def test_lines_of_null_and_repeated_ids(spark):
    line, near = "a line of some length", "a line of sum3 length"
    rows = [(None, line), (1, line), (1, line), (1, "own words here"), (2, "own words her"), (2, near)]
    found = lines.line_report(brute.documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.n_near) for r in found) == [
        (-1, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1),
    ]


@pytest.mark.parametrize("name", ["op3_near_line_dedup", "op4_repeated_passages", "op7_prefix_jaccard_join"])
def test_registered_query_equals_sql(spark, name):
    directory = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{directory}/documents.parquet'")
    mine = queries.QUERIES[name](spark, directory)
    other = con.sql(queries.ORACLE[name])
    columns = sorted(mine.columns)
    assert sorted(other.columns) == columns
    rows = sorted(tuple(r) for r in mine.select(*columns).collect())
    assert rows == sorted(other.project(", ".join(columns)).fetchall()) and rows
