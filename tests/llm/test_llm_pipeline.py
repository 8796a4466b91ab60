import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from corpuskit import session
from corpuskit.llm import mixture, packing, queries


def test_names():
    registered = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in registered) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in registered and set(queries.ORACLE) <= set(registered) and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard", "source_mixing", "sequence_packing",
    ]


def fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    odd = [(9001, None, "en", "src0", 0), (9002, "?! 12", "en", "src1", 5), (9003, "", None, None, 0)]
    near = rows[3][1].replace("the", "teh", 1)
    odd += [(9004, near, "en", None, len(near)), (9005, rows[4][1], "en", "src1", len(rows[4][1]))]
    return rows + odd


def test_run_matches_brute_force(spark, tmp_path):
    rows = fixture(spark)
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    source = {r[0]: r[3] for r in rows}
    docs = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    docs = {
        d: "\n".join(kept)
        for d, (kept, gone, _) in brute.kept_lines(docs).items()
        if not gone or "".join(kept).strip(brute.BLANKS)
    }
    docs = {d: t for d, t in docs.items() if brute.components(docs)[d][1] == d} if len(docs) < 1 else _firsts(docs)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(d, t, source[d]) for d, t in docs.items()])
    copies = {}
    for doc_id, size, _, _, taken in con.sql(mixture.MIX_SQL).fetchall():
        copies[doc_id] = taken // size if size else 0
    slow = packing.Encoder(ranks=None)
    wanted = Counter()
    for d, t in docs.items():
        ids = np.append(slow.ids(t), np.array([0], "<u4")).astype("<u4")
        points = [0, *range(len(ids) % 2048 or min(len(ids), 2048), len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(points, points[1:])):
            if copies[d]:
                wanted[d, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += copies[d]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    held = defaultdict(int)
    for r in found:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048


def _firsts(docs):
    grouped = brute.components(docs)
    return {d: t for d, t in docs.items() if grouped[d][1] == d}


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame(fixture(spark), brute.SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/nowhere")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert [f.dataType for f in docs.schema] == [f.dataType for f in spark.createDataFrame([], brute.SCHEMA).schema]


def test_stages_set_the_session(spark):
    docs = spark.createDataFrame([], brute.SCHEMA)
    alone = spark.newSession()
    for _, stage in corpus_pipeline.STAGES:
        for key in session.RUNTIME_SETTINGS:
            alone.conf.unset(key)
        stage(alone, docs, "/nowhere")
        assert {key: alone.conf.get(key) for key in session.RUNTIME_SETTINGS} == session.RUNTIME_SETTINGS


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], brute.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
