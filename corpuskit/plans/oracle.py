"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from corpuskit.plans.catalog import FITTED, PIECES, SEED, TRAINED, VOCAB

# The two word classes spelled out by category, since RE2 knows neither as one name.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARK = r"\x{FDD0}-\x{FDDF}"
_PATTERN = rf"[{_MARK}]|[{_WORD}]+|[^{_WORD}{_SPACE}{_MARK}]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '{_PATTERN}')"


_COUNTS = f"""
docw AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
wc AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM docw) GROUP BY word)"""

_VOCAB = f"""{_COUNTS},
pv AS (SELECT word AS piece, (5 + row_number() OVER (ORDER BY n DESC, word))::int AS id FROM wc
       QUALIFY id < {VOCAB})"""


def _greedy(rows: str, keys: str) -> str:
    """Ids of every row of ``rows`` (``keys`` and its word list ``ws``): longest known piece first, from the left."""
    return f"""
placed AS (SELECT {keys}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM {rows}),
todo AS (SELECT DISTINCT word FROM placed),
longest AS (SELECT max(length(piece)) AS m FROM pv),
walk AS (
  SELECT word, 1::bigint AS p, []::int[] AS ids FROM todo WHERE length(word) <= 100
  UNION ALL
  SELECT word, p + l, list_append(ids, id) FROM (
    SELECT w.word, w.p, w.ids, c.l, v.id, row_number() OVER (PARTITION BY w.word, w.p ORDER BY c.l DESC) AS best
    FROM walk w, LATERAL (SELECT unnest(range(1, least((SELECT m FROM longest), length(w.word) - w.p + 1) + 1)) AS l) c
    JOIN pv v ON v.piece = CASE WHEN w.p > 1 THEN '##' ELSE '' END || substr(w.word, w.p::int, c.l::int)
    WHERE w.p <= length(w.word)) WHERE best = 1),
greedy AS (SELECT word, coalesce(ids, [0::int]) AS ids FROM todo
           LEFT JOIN (SELECT word, ids FROM walk WHERE p = length(word) + 1) USING (word)),
coded AS (SELECT {keys}, coalesce(ids, []::int[]) AS ids FROM {rows} LEFT JOIN
          (SELECT {keys}, flatten(list(ids ORDER BY pos)) AS ids FROM placed JOIN greedy USING (word) GROUP BY ALL)
          USING ({keys}))"""



_CONTENT = f"""{_VOCAB}, {_greedy("docw", "doc_id")}"""

_ENCODED = f"""{_CONTENT},
enc AS (SELECT doc_id, [1::int] || ids || [3::int] AS ids FROM coded)"""


_PIECES_OF = """
names AS (SELECT id, piece FROM pv UNION ALL
          SELECT unnest(range(6))::int, unnest(['[UNK]', '[CLS]', '[SEP]', '[EOS]', '[PAD]', '[MASK]'])),
pieces AS (SELECT doc_id, i, id, piece FROM
           (SELECT doc_id, i, ids[i] AS id FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM enc))
           JOIN names USING (id))"""


def _md5(ids: str) -> str:
    return f"md5(array_to_string({ids}, ','))"


def _hash(key: str, seed=SEED) -> str:
    return f"md5('{seed}:' || {key})"


def _fraction(key: str) -> str:
    return f"('0x' || substr({_hash(key)}, 1, 8))::bigint / 4294967296.0::double"


def _message(text: str = "text") -> str:
    return f"'[' || role || ']' || chr(10) || {text} || chr(10) || '[SEP]' || chr(10)"


_CHAT = f"SELECT conv_id, string_agg({_message()}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"

_SEGMENTS = """
cut AS (SELECT doc_id, ids, len(ids) AS len, CASE WHEN len(ids) < {c} THEN 1 ELSE ceil(len(ids) / {s}.0)::int END AS n
        FROM enc),
windowed AS (SELECT doc_id, ids, len, n, unnest(range(n))::int AS k FROM cut),
seg AS (SELECT doc_id, k, n, len, CASE WHEN len < {c} THEN ids WHEN k < n - 1 THEN ids[k * {s} + 1 : k * {s} + {c}]
        ELSE ids[len - {c} + 1 : len] END AS ids FROM windowed)"""

_SPLIT_COUNTS = """
ranked AS (SELECT *, row_number() OVER (ORDER BY {h}) AS r, count(*) OVER () AS total FROM {rows})
SELECT CASE WHEN r <= ceil(0.1::double * total) THEN 'test' ELSE 'train' END AS split,
       count(*) AS n_windows, sum(len(ids))::bigint AS n_ids{more}
FROM ranked GROUP BY 1"""

_FRAGMENTS = f"""{_COUNTS},
frag AS (
  SELECT substr(word, 1, k::int) AS piece, n FROM (SELECT word, n, unnest(range(1, least(4, length(word)) + 1)) AS k FROM wc)
  UNION ALL
  SELECT '##' || substr(word, p::int, k::int), n
  FROM (SELECT word, n, p, unnest(range(1, least(3, length(word) - p + 1) + 1)) AS k
        FROM (SELECT word, n, unnest(range(2, length(word) + 1)) AS p FROM wc))),
fc AS (SELECT piece, sum(n)::bigint AS n FROM frag GROUP BY piece),
pv AS (SELECT piece, (5 + row_number() OVER (ORDER BY n DESC, piece))::int AS id FROM fc QUALIFY id < {PIECES + 6})"""

_MODEL = f"""{_ENCODED},
bi AS (SELECT a, b, count(*) AS n FROM
       (SELECT ids[i] AS a, ids[i + 1] AS b FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM enc)) GROUP BY a, b)"""

_HELD_OUT = f"""{_ENCODED},
pairs AS (SELECT doc_id, {_fraction("doc_id")} < 0.1::double AS is_test, ids[i] AS a, ids[i + 1] AS b
          FROM (SELECT doc_id, ids, unnest(range(1, len(ids))) AS i FROM enc)),
bi AS (SELECT a, b, count(*) AS n FROM pairs WHERE NOT is_test GROUP BY a, b),
tot AS (SELECT a, sum(n) AS t FROM bi GROUP BY a),
held AS (SELECT doc_id, a, b, count(*) AS m FROM pairs WHERE is_test AND b <> 4 GROUP BY doc_id, a, b),
scored AS (SELECT doc_id, m, -ln((coalesce(n, 0) + 0.5::double) / (coalesce(t, 0) + 0.5::double * {VOCAB})) AS loss
           FROM held LEFT JOIN bi USING (a, b) LEFT JOIN tot USING (a))"""

# Discounted counts, and below them the number of contexts of a token, discounted likewise, and all tokens alike.
_BACKOFF = f"""{_HELD_OUT},
ctx AS (SELECT a, sum(n) AS t, 0.75::double * count(*) / sum(n) AS spare FROM bi GROUP BY a),
kinds AS (SELECT b, count(*) AS k FROM bi GROUP BY b),
every AS (SELECT sum(k)::double AS pairs, 0.75::double * count(*) / sum(k) / {VOCAB} AS unseen FROM kinds),
backed AS (SELECT doc_id, m, -ln(greatest(coalesce(n, 0) - 0.75::double, 0) / coalesce(t, 1)
             + coalesce(spare, 1) * (coalesce((k - 0.75::double) / pairs, 0) + unseen)) AS loss
           FROM held LEFT JOIN bi USING (a, b) LEFT JOIN ctx USING (a) LEFT JOIN kinds USING (b), every)"""

_UNIT = """unit AS (SELECT vec_id::int AS id,
  list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS vec
  FROM embeddings)"""

_PLACED = f"""{_ENCODED.replace(f"id < {VOCAB}", "id < (SELECT count(*) FROM embeddings)")}, {_UNIT},
emb AS (SELECT doc_id, (i - 1)::int AS pos, id, vec
        FROM (SELECT doc_id, i, ids[i] AS id FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM enc))
        LEFT JOIN unit USING (id))"""

_LOG = "log AS (SELECT user_id AS run, event_id AS step, ts, value AS loss FROM events)"


_LEARNED = f"""{_COUNTS},
chars AS (SELECT word, i, substr(word, i::int, 1) AS ch FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM wc)),
base AS (SELECT DISTINCT ch AS piece, 0 AS inside FROM chars UNION SELECT DISTINCT '##' || ch, 1 FROM chars WHERE i > 1),
merges(key, n, packed, a, b, step) USING KEY (key) AS (
  SELECT word, n, ' ' || string_agg(CASE WHEN i = 1 THEN '' ELSE '##' END || ch, '  ' ORDER BY i) || ' ', '', '', 0
  FROM chars JOIN wc USING (word) GROUP BY word, n
  UNION ALL
  (WITH state AS (SELECT * FROM recurring.merges),
  parts AS (SELECT n, string_split(trim(packed), '  ') AS p FROM state
            WHERE packed IS NOT NULL AND contains(packed, '  ')),
  pairs AS (SELECT n, p[i] AS a, p[i + 1] AS b FROM (SELECT n, p, unnest(range(1, len(p))) AS i FROM parts)),
  made AS (SELECT count(DISTINCT a || substr(b, 3)) AS k FROM state
           WHERE packed IS NULL AND a || substr(b, 3) NOT IN (SELECT piece FROM base)),
  best AS (SELECT a, b, (SELECT max(step) FROM state) + 1 AS step FROM pairs
           WHERE (SELECT k FROM made) < {TRAINED - 6} - (SELECT count(*) FROM base)
           GROUP BY a, b ORDER BY sum(n) DESC, a, b LIMIT 1)
  SELECT s.key, s.n, replace(s.packed, ' ' || best.a || '  ' || best.b || ' ', ' ' || best.a || substr(best.b, 3) || ' '),
         '', '', best.step
  FROM state s, best WHERE s.packed IS NOT NULL AND contains(s.packed, ' ' || best.a || '  ' || best.b || ' ')
  UNION ALL SELECT ' merge ' || best.step, 0, NULL, best.a, best.b, best.step FROM best)),
learned AS (SELECT a || substr(b, 3) AS piece, min(step) AS step FROM merges
            WHERE packed IS NULL AND a || substr(b, 3) NOT IN (SELECT piece FROM base) GROUP BY 1)"""


def _fit(examples: str, epochs: int, dim: int, decay: float, normal: bool, bias: bool) -> str:
    """Full-batch softmax fit on ``ex (ctx, target, n)``, one column per dimension, one set of tables per step."""
    dims = range(1, dim + 1)
    lr = f"{1 / dim}::double"

    def each(text: str) -> str:
        return ", ".join(text.format(i=i) for i in dims)

    def start(seed: int) -> str:
        raw = each(_fraction("id || ':{i}'").replace(f"'{SEED}:'", f"'{seed}:'") + " - 0.5::double AS r{i}")
        length = "sqrt(" + " + ".join(f"r{i} * r{i}" for i in dims) + ")"
        return (
            f"SELECT id, {each(f'r{{i}} / {length} AS w{{i}}, 0::double AS s{{i}}')}, 0::double AS b, 0::double AS bs "
            f"FROM (SELECT id, {raw} FROM (SELECT unnest(range({FITTED}))::int AS id))"
        )

    def step(table: str, grads: str, with_bias: bool) -> str:
        moved = each(
            "w{i} - " + lr + " * d{i} / (sqrt(s{i} + d{i} * d{i}) + 1e-10::double) AS w{i}, s{i} + d{i} * d{i} AS s{i}"
        )
        shift = f"b - {lr} * db / (sqrt(bs + db * db) + 1e-10::double) AS b, bs + db * db AS bs" if with_bias else "b, bs"
        inner = each(f"coalesce(g{{i}}, 0) + {decay}::double * w{{i}} AS d{{i}}")
        row = (
            f"SELECT id, {moved}, {shift} FROM (SELECT t.*, {inner}, coalesce(gb, 0) + {decay}::double * b AS db "
            f"FROM {table} t LEFT JOIN {grads} USING (id))"
        )
        if not normal:
            return row
        length = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in dims) + ")"
        return f"SELECT id, {each(f'w{{i}} / {length} AS w{{i}}, s{{i}}')}, b, bs FROM ({row})"

    dot = " + ".join(f"x.w{i} * o.w{i}" for i in dims)
    parts = [
        examples,
        "cx AS MATERIALIZED (SELECT ctx, sum(n) AS total FROM ex GROUP BY ctx)",
        "size AS MATERIALIZED (SELECT sum(n)::double AS n FROM ex)",
        f"i0 AS MATERIALIZED ({start(0)})",
        f"o0 AS MATERIALIZED ({start(1)})",
    ]
    for e in range(epochs):
        parts += [
            f"""x{e} AS MATERIALIZED (SELECT ctx, any_value(total) AS total, {each("sum(w{i}) AS w{i}")}
                FROM (SELECT ctx, total, unnest(ctx) AS id FROM cx) JOIN i{e} USING (id) GROUP BY ctx)""",
            f"""s{e} AS MATERIALIZED (SELECT x.ctx, o.id AS target, {dot} + o.b AS s FROM x{e} x, o{e} o)""",
            f"z{e} AS MATERIALIZED (SELECT ctx, ln(sum(exp(s))) AS z FROM s{e} GROUP BY ctx)",
            f"""g{e} AS MATERIALIZED (SELECT ctx, target, (exp(s - z) * total - coalesce(n, 0)) / (SELECT n FROM size) AS g
                FROM s{e} JOIN z{e} USING (ctx) JOIN cx USING (ctx) LEFT JOIN ex USING (ctx, target))""",
            f"""l{e} AS (SELECT {e} AS step, sum(n * (z - s)) / (SELECT n FROM size) AS loss
                FROM ex JOIN s{e} USING (ctx, target) JOIN z{e} USING (ctx))""",
            f"""og{e} AS (SELECT target AS id, {each("sum(g * x.w{i}) AS g{i}")}, sum(g) AS gb
                FROM g{e} JOIN x{e} x USING (ctx) GROUP BY target)""",
            f"""cg{e} AS (SELECT ctx, {each("sum(g * o.w{i}) AS g{i}")} FROM g{e} JOIN o{e} o ON o.id = target GROUP BY ctx)""",
            f"""ig{e} AS (SELECT id, {each("sum(g{i}) AS g{i}")}, 0::double AS gb
                FROM (SELECT unnest(ctx) AS id, * FROM cg{e}) GROUP BY id)""",
            f"i{e + 1} AS MATERIALIZED ({step(f'i{e}', f'ig{e}', False)})",
            f"o{e + 1} AS MATERIALIZED ({step(f'o{e}', f'og{e}', bias)})",
        ]
    losses = " UNION ALL ".join(f"SELECT * FROM l{e}" for e in range(epochs))
    return ", ".join(parts) + f" SELECT step, round(loss, 6) AS loss FROM ({losses})"


_FIT_IDS = f"""{_CONTENT.replace(f"id < {VOCAB}", f"id < {FITTED}")},
cut AS (SELECT [1::int] || ids || [3::int] AS ids FROM coded)"""


def _text_md5(rows: str, keys: str, text: str = "text") -> str:
    return f"SELECT {keys}, length({text})::int AS n_chars, md5({text}) AS text_md5 FROM ({rows})"


def _tidy(piece: str) -> str:
    for raw, clean in ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ",")):
        piece = f"replace({piece}, '{raw}', '{clean}')"
    return piece


ORACLE: dict[str, str] = {
    "jsonl_render": _text_md5(_CHAT, "conv_id"),
    "read_registered_source": _text_md5("SELECT * FROM documents WHERE lang = 'de'", "doc_id, lang"),
    "materialized_split": f"""SELECT CASE WHEN {_fraction("doc_id")} < 0.1::double THEN 'test' ELSE 'train' END AS split,
        source, count(*) AS n FROM documents GROUP BY 1, 2""",
    "peek_row": "SELECT doc_id, length(text)::int AS n_chars FROM documents ORDER BY doc_id LIMIT 1",
    "project_pages": _text_md5("SELECT html, page_id FROM pages", "page_id", "html"),
    "source_views": """
        SELECT c_custkey, 'name' AS view, c_custkey::varchar AS key, c_name AS answer FROM customer
        UNION ALL SELECT c_custkey, 'segment', c_custkey::varchar, c_mktsegment FROM customer""",
    "map_batches": """SELECT doc_id, (i - 1)::int AS line_no, length(line)::int AS n_chars FROM
        (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
         FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
    "render_fields_customer": """SELECT c_custkey, 'c_name' || chr(10) || c_name || chr(10) || 'end' || chr(10)
        || 'c_mktsegment' || chr(10) || c_mktsegment || chr(10) || 'end' || chr(10)
        || 'c_nationkey' || chr(10) || c_nationkey || chr(10) || 'end' || chr(10)
        || 'c_custkey' || chr(10) || c_custkey || chr(10) || 'end' || chr(10) AS text FROM customer""",
    "render_pair_orders": "SELECT o_orderkey, o_orderpriority || chr(10) || o_orderstatus AS text FROM orders",
    "render_chat": _CHAT,
    "render_prompt": f"""WITH t AS (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS is_last FROM conversations)
        SELECT conv_id, coalesce(string_agg({_message()}, '' ORDER BY turn) FILTER (NOT is_last), '')
               || '[' || max(role) FILTER (is_last) || ']' || chr(10) AS text FROM t GROUP BY conv_id""",
    "concat_sources": _text_md5(
        f"""SELECT 'documents' AS source, doc_id AS id, text FROM documents
        UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
        UNION ALL SELECT 'chats', conv_id, text FROM ({_CHAT})""",
        "source, id",
    ),
    "mixture_weighted": f"""WITH w AS (SELECT doc_id, lang, CASE lang WHEN 'de' THEN 2 WHEN 'es' THEN 0
          WHEN 'fr' THEN 1 + ({_fraction("doc_id")} < 0.5::double)::int ELSE 1 END AS copies FROM documents)
        SELECT doc_id, lang, unnest(range(1, copies + 1))::int AS copy_no FROM w""",
    "shuffle_positions": f"SELECT doc_id, row_number() OVER (ORDER BY {_hash('doc_id')}) AS position FROM documents",
    "sample_n": f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        ORDER BY {_hash("l_orderkey || ':' || l_linenumber", 42)} LIMIT 500""",
    "sample_batch": """SELECT count(*) AS n, trunc(avg(n_chars))::bigint AS mean_chars
        FROM (SELECT n_chars FROM documents ORDER BY md5('42:' || doc_id) LIMIT 819200)""",
    "split_exact": f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_hash("doc_id")})
        <= ceil(0.1::double * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents""",
    "split_hash": f"""SELECT doc_id, CASE WHEN {_fraction("doc_id")} < 0.1::double THEN 'test' ELSE 'train' END AS split
        FROM documents""",
    "split_by_group": f"""SELECT conv_id, turn, CASE WHEN {_fraction("conv_id")} < 0.2::double THEN 'test'
        ELSE 'train' END AS split FROM conversations""",
    "normalize_text": _text_md5("SELECT doc_id, strip_accents(lower(text)) AS text FROM documents", "doc_id"),
    "pretokenize": f"""WITH RECURSIVE {_COUNTS} SELECT doc_id, len(ws)::int AS n_words, md5(array_to_string(ws, ' ')) AS words_md5
        FROM docw""",
    "word_counts": f"WITH RECURSIVE {_COUNTS} SELECT word, n FROM wc",
    "alphabet": f"""WITH RECURSIVE {_COUNTS}, c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM wc)
        SELECT CASE WHEN i = 1 THEN '' ELSE '##' END || substr(word, i::int, 1) AS piece, sum(n)::bigint AS n
        FROM c GROUP BY 1""",
    "pair_counts_round0": f"""WITH RECURSIVE {_COUNTS}, c AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM wc)
        SELECT CASE WHEN i = 1 THEN '' ELSE '##' END || substr(word, i::int, 1) AS a,
               '##' || substr(word, i::int + 1, 1) AS b, sum(n)::bigint AS n FROM c GROUP BY 1, 2""",
    "build_vocab": f"""WITH RECURSIVE {_FRAGMENTS} SELECT id, piece, 'piece' AS kind FROM pv UNION ALL
        SELECT unnest(range(6))::int, unnest(['[UNK]', '[CLS]', '[SEP]', '[EOS]', '[PAD]', '[MASK]']), 'special'""",
    "vocab_saved": f"""WITH RECURSIVE {_VOCAB} SELECT id, piece, 'piece' AS kind FROM pv UNION ALL
        SELECT unnest(range(6))::int, unnest(['[UNK]', '[CLS]', '[SEP]', '[EOS]', '[PAD]', '[MASK]']), 'special'""",
    "train_wordpiece": f"""WITH RECURSIVE {_LEARNED}
        SELECT unnest(range(6))::int AS id, unnest(['[UNK]', '[CLS]', '[SEP]', '[EOS]', '[PAD]', '[MASK]']) AS piece,
               'special' AS kind
        UNION ALL SELECT (5 + row_number() OVER (ORDER BY inside, piece))::int, piece, 'piece' FROM base
        UNION ALL SELECT (5 + (SELECT count(*) FROM base) + row_number() OVER (ORDER BY step))::int, piece, 'piece'
        FROM learned""",
    "encode_word_vocab": f"WITH RECURSIVE {_ENCODED} SELECT doc_id, len(ids)::int AS n_ids, {_md5('ids')} AS ids_md5 FROM enc",
    "encode_distinct_words": f"""WITH RECURSIVE {_FRAGMENTS}, {_greedy("docw", "doc_id")}
        SELECT word, len(ids)::int AS n_ids, {_md5("ids")} AS ids_md5 FROM greedy""",
    "encode_wordpiece": f"""WITH RECURSIVE {_FRAGMENTS}, {_greedy("docw", "doc_id")},
        enc AS (SELECT doc_id, [1::int] || ids || [3::int] AS ids FROM coded)
        SELECT doc_id, len(ids)::int AS n_ids, {_md5("ids")} AS ids_md5 FROM enc""",
    "encode_chat": f"""WITH RECURSIVE {_VOCAB}, chat AS ({_CHAT}),
        known AS (SELECT * FROM pv UNION ALL SELECT chr(64978), 2),
        cw AS (SELECT conv_id, {_words("replace(text, '[SEP]', chr(64978))")} AS ws FROM chat),
        {_greedy("cw", "conv_id").replace("JOIN pv v", "JOIN known v")},
        e AS (SELECT conv_id, [1::int] || ids || [3::int] AS ids FROM coded)
        SELECT conv_id, len(list_filter(ids, lambda x: x = 2))::int AS n_sep, len(ids)::int AS n_ids,
               {_md5("ids")} AS ids_md5 FROM e""",
    "add_template_pair": f"""WITH RECURSIVE {_VOCAB},
        cw AS (SELECT conv_id, turn, {_words("text")} AS ws FROM conversations),
        {_greedy("cw", "conv_id, turn")},
        p AS (SELECT conv_id, turn, ids, lead(ids) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM coded),
        e AS (SELECT conv_id, turn, [1::int] || ids || [2::int] || nx || [3::int] AS ids, len(nx) AS n FROM p
              WHERE nx IS NOT NULL)
        SELECT conv_id, turn, n::int AS n_type1, len(ids)::int AS n_ids, {_md5("ids")} AS ids_md5 FROM e""",
    "token_strings": f"""WITH RECURSIVE {_ENCODED}, {_PIECES_OF},
        e AS (SELECT doc_id, list(piece ORDER BY i) AS ts FROM pieces GROUP BY doc_id)
        SELECT doc_id, len(ts)::int AS n_ids, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM e""",
    "truncate_pad": f"""WITH RECURSIVE {_CONTENT},
        p AS (SELECT doc_id, list_resize([1::int] || ids[1:1022] || [3::int], 1024, 3::int) AS ids FROM coded)
        SELECT doc_id, len(ids)::int AS n_ids, {_md5("ids")} AS ids_md5 FROM p""",
    "decode_roundtrip": f"""WITH RECURSIVE {_ENCODED}, {_PIECES_OF},
        t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, piece FROM pieces WHERE id > 5),
        g AS (SELECT doc_id, i, CASE WHEN i = 1 THEN piece WHEN starts_with(piece, '##') THEN substr(piece, 3)
              ELSE ' ' || piece END AS piece FROM t),
        s AS (SELECT doc_id, string_agg({_tidy("piece")}, '' ORDER BY i) AS text FROM g GROUP BY doc_id)
        SELECT doc_id, length(coalesce(s.text, ''))::int AS n_chars, md5(coalesce(s.text, '')) AS text_md5
        FROM documents LEFT JOIN s USING (doc_id)""",
    "segment": f"""WITH RECURSIVE {_ENCODED}, {_SEGMENTS.format(c=512, s=507)}
        SELECT doc_id, k AS chunk_no, len(ids)::int AS n_ids, {_md5("ids")} AS ids_md5 FROM seg""",
    "segment_short": f"""WITH RECURSIVE {_ENCODED}, {_SEGMENTS.format(c=64, s=57)}
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::int AS chunk_no,
               len(ids)::int AS n_ids, {_md5("ids")} AS ids_md5
        FROM seg WHERE len < 64 OR k = n - 1 OR k * 57 < len - 64""",
    "tail": f"""WITH RECURSIVE {_ENCODED} SELECT doc_id, len(ids[-512:])::int AS n_ids, {_md5("ids[-512:]")} AS ids_md5 FROM enc""",
    "row_pairs": f"""WITH RECURSIVE {_ENCODED}, r AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_no
          FROM enc),
        l AS (SELECT *, lead(ids) OVER (PARTITION BY batch_no ORDER BY doc_id) AS nx FROM r)
        SELECT doc_id, batch_no::bigint AS batch_no, {_md5("ids")} AS ids_md5, {_md5("nx")} AS next_md5 FROM l
        WHERE nx IS NOT NULL""",
    "adjacent_pairs": f"""WITH RECURSIVE {_ENCODED} SELECT doc_id, (i - 1)::int AS pos, ids[i] AS a, ids[i + 1] AS b
        FROM (SELECT doc_id, ids, unnest(range(1, len(ids))) AS i FROM enc)""",
    "cbow2": f"""WITH RECURSIVE {_ENCODED} SELECT doc_id, i::int AS pos, ids[i] || ',' || ids[i + 2] AS context,
        ids[i + 1] AS target FROM (SELECT doc_id, ids, unnest(range(2, len(ids) - 2)) AS i FROM enc)""",
    "cbow4": f"""WITH RECURSIVE {_ENCODED} SELECT doc_id, i::int AS pos,
        ids[i - 1] || ',' || ids[i] || ',' || ids[i + 2] || ',' || ids[i + 3] AS context, ids[i + 1] AS target
        FROM (SELECT doc_id, ids, unnest(range(2, len(ids) - 2)) AS i FROM enc)""",
    "causal_examples": f"""WITH RECURSIVE {_ENCODED} SELECT doc_id, len(list_filter(ids[2:], lambda x: x <> 6))::int AS n_labels,
        {_md5("ids[1:len(ids) - 1]")} AS input_md5, {_md5("ids[2:]")} AS label_md5 FROM enc""",
    "table_saved": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "sample_batch_tokens": f"""WITH RECURSIVE {_ENCODED},
        batch AS (SELECT doc_id FROM documents ORDER BY {_hash("doc_id", 42)}, doc_id LIMIT 100)
        SELECT count(*) AS n_rows, trunc(avg(len(ids)))::bigint AS mean_tokens FROM enc JOIN batch USING (doc_id)""",
    "length_stats": f"""WITH RECURSIVE {_ENCODED} SELECT count(*) AS n_rows, min(len(ids))::int AS min_len, max(len(ids))::int AS max_len,
        round(avg(len(ids)), 6) AS mean_len, trunc(avg(len(ids)))::bigint AS mean_len_int FROM enc""",
    "length_quantiles": f"""WITH RECURSIVE {_ENCODED}, q AS (SELECT [0, 0.25, 0.5, 0.75, 0.9, 0.99, 1]::double[] AS qs)
        SELECT unnest(qs) AS quantile, unnest((SELECT quantile_disc(len(ids)::int, [0, 0.25, 0.5, 0.75, 0.9, 0.99, 1]::double[])
          FROM enc)) AS length FROM q""",
    "training_windows": f"""WITH RECURSIVE {_ENCODED}, {_SEGMENTS.format(c=512, s=507)},
        {_SPLIT_COUNTS.format(h=_hash("doc_id || ':' || k"), rows="seg", more=", count(DISTINCT doc_id) AS n_docs")}""",
    "training_tails": f"""WITH RECURSIVE {_ENCODED}, last AS (SELECT doc_id, ids[-512:] AS ids FROM enc),
        {_SPLIT_COUNTS.format(h=_hash("doc_id || ':0'"), rows="last", more="")}""",
    "assembled_corpus": _text_md5(
        f"""SELECT 'documents' AS source, doc_id, 1 AS copy_no, 'lang' || chr(10) || lang || chr(10) || 'end' || chr(10)
              || 'text' || chr(10) || text || chr(10) || 'end' || chr(10) AS text FROM documents
        UNION ALL SELECT 'pages', page_id, 1, url || chr(10) || html FROM pages
        UNION ALL SELECT 'chats', conv_id, unnest([1, 2]), text FROM ({_CHAT})""",
        "source, doc_id, copy_no::int AS copy_no",
    ),
    "bigram_counts": f"WITH RECURSIVE {_MODEL} SELECT a, b, n FROM bi",
    "pair_weights": f"""WITH RECURSIVE {_CONTENT}, cut AS (SELECT [1::int] || ids || [3::int] AS ids FROM coded),
        full_ids AS (SELECT list_resize(ids, greatest(len(ids), 1024), 4::int) AS ids, len(ids) AS len FROM cut),
        p AS (SELECT ids[i] AS a, ids[i + 1] AS b, (i < len)::int AS inside
              FROM (SELECT ids, len, unnest(range(1, len(ids))) AS i FROM full_ids))
        SELECT a, b, sum(inside)::bigint AS n, count(*) AS n_padded FROM p GROUP BY a, b""",
    "context_counts": f"""WITH RECURSIVE {_ENCODED}, c AS (SELECT list_sort([ids[i], ids[i + 2]]) AS ctx, ids[i + 1] AS target
          FROM (SELECT ids, unnest(range(2, len(ids) - 2)) AS i FROM enc))
        SELECT array_to_string(ctx, ',') AS context, target, count(*) AS n FROM c GROUP BY ctx, target""",
    "next_token_model": f"""WITH RECURSIVE {_MODEL} SELECT a, b, n, (sum(n) OVER w)::bigint AS total,
        round((n + 0.5::double) / ((sum(n) OVER w) + 0.5::double * {VOCAB}), 9) AS p FROM bi WINDOW w AS (PARTITION BY a)""",
    "next_token_topk": f"""WITH RECURSIVE {_MODEL},
        r AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b)::int AS rank FROM bi QUALIFY rank <= 2)
        SELECT a, b, rank, round(n / (sum(n) OVER (PARTITION BY a))::double, 9) AS p_topk FROM r""",
    "cross_entropy": f"""WITH RECURSIVE {_HELD_OUT} SELECT sum(m)::bigint AS n_labels,
        round(sum(m * loss) / sum(m), 6) AS cross_entropy FROM scored""",
    "cross_entropy_by_document": f"""WITH RECURSIVE {_HELD_OUT} SELECT doc_id, sum(m)::bigint AS n_labels,
        round(sum(m * loss) / sum(m), 6) AS cross_entropy FROM scored GROUP BY doc_id""",
    "cross_entropy_backoff": f"""WITH RECURSIVE {_BACKOFF} SELECT doc_id, sum(m)::bigint AS n_labels,
        round(sum(m * loss) / sum(m), 6) AS cross_entropy FROM backed GROUP BY doc_id""",
    "fit_skipgram": f"WITH RECURSIVE {_FIT_IDS}, "
    + _fit(
        """ex AS MATERIALIZED (SELECT [a] AS ctx, b AS target, count(*) AS n FROM (SELECT ids[i] AS a, ids[i + 1] AS b
        FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM cut)) GROUP BY a, b)""",
        epochs=3, dim=16, decay=0.01, normal=False, bias=False,
    ),
    "fit_cbow": f"WITH RECURSIVE {_FIT_IDS}, "
    + _fit(
        """ex AS MATERIALIZED (SELECT list_sort([ids[i], ids[i + 2]]) AS ctx, ids[i + 1] AS target, count(*) AS n
        FROM (SELECT ids, unnest(range(2, len(ids) - 2)) AS i FROM cut) GROUP BY ALL)""",
        epochs=3, dim=16, decay=0.01, normal=True, bias=True,
    ),
    "l2_normalize": f"""WITH RECURSIVE {_UNIT} SELECT id, (i - 1)::int AS pos, round(vec[i], 6) AS x
        FROM (SELECT id, vec, unnest(range(1, len(vec) + 1)) AS i FROM unit)""",
    "embed_lookup": f"WITH RECURSIVE {_PLACED} SELECT doc_id, pos, id, round(list_sum(vec), 6) AS vec_sum FROM emb",
    "dot_to_anchor": f"""WITH RECURSIVE {_PLACED} SELECT e.doc_id, e.pos, e.id, round(list_dot_product(e.vec, a.vec), 6) AS dot
        FROM emb e JOIN emb a ON a.doc_id = e.doc_id AND a.pos = 1 AND e.pos > 1""",
    "dot_to_row": f"""WITH RECURSIVE {_UNIT} SELECT u.id, round(list_dot_product(u.vec, a.vec), 6) AS dot
        FROM unit u JOIN unit a ON a.id = 1""",
    "top_neighbors": f"""WITH RECURSIVE {_UNIT}, s AS (SELECT a.id::bigint AS anchor, u.id::bigint AS id,
          list_dot_product(u.vec, a.vec) AS score FROM unit a JOIN unit u ON a.id <> u.id)
        SELECT anchor, id, round(score, 6) AS score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id)::int AS rank
        FROM s QUALIFY rank <= 5""",
    "embedding_saved": """SELECT vec_id::int AS id,
        round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS norm FROM embeddings""",
    "loss_log_read": f"""WITH RECURSIVE {_LOG} SELECT run, (row_number() OVER (PARTITION BY run ORDER BY ts, step) - 1)::int AS step,
        loss FROM log""",
    "loss_new_best": f"""WITH RECURSIVE {_LOG} SELECT run, step, loss, CASE WHEN min(loss) OVER (PARTITION BY run ORDER BY ts, step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > loss THEN 1 ELSE 0 END AS is_best FROM log""",
    "loss_spike": f"""WITH RECURSIVE {_LOG} SELECT run, step, loss, CASE WHEN loss - lag(loss, 1) OVER w
        > abs(lag(loss, 1) OVER w - lag(loss, 2) OVER w) THEN 1 ELSE 0 END AS is_spike
        FROM log WINDOW w AS (PARTITION BY run ORDER BY ts, step)""",
    "loss_every": f"WITH RECURSIVE {_LOG} SELECT run, step, loss FROM log WHERE step % 12 = 0",
    "trial_summary": f"""WITH RECURSIVE {_LOG}, s AS (SELECT run, count(*) AS n_steps, min(loss) AS min_loss,
          arg_max(loss, step) AS last_loss, round(avg(loss), 6) AS mean_loss FROM log GROUP BY run)
        SELECT run, n_steps, min_loss, last_loss, mean_loss, c_mktsegment,
               row_number() OVER (ORDER BY min_loss, run) AS rank FROM s LEFT JOIN customer ON c_custkey = run""",
}
