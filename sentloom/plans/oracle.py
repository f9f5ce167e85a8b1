"""The same queries in DuckDB's SQL."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
EPS = "1.1920928955078125e-07"


def _tokens(table: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key} AS idx, unnest({_WORDS}) AS word FROM {table}"


_VOCAB = f"""tok AS MATERIALIZED ({_tokens()}),
    cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
    ranked AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM cnt),
    wv AS MATERIALIZED (SELECT k.word, k.n, k.r, e.embedding::DOUBLE[] AS v FROM ranked k JOIN embeddings e ON e.vec_id = k.r)"""
SIF = "(1e-3 / (1e-3 + n::DOUBLE / (SELECT sum(n)::DOUBLE FROM wv)))"
_USIF_A = f"""(SELECT (1 - al) / (al * vn / 2 + {EPS}) FROM (SELECT vn, (SELECT count(*) FROM wv WHERE wv.n::DOUBLE / sn > 1 - pow(1 - 1.0::DOUBLE / vn, 11))::DOUBLE / vn AS al FROM (SELECT count(*)::DOUBLE AS vn, sum(n)::DOUBLE AS sn FROM wv)))"""
USIF = f"({_USIF_A} / ({_USIF_A} / 2 + n::DOUBLE / (SELECT sum(n)::DOUBLE FROM wv)))"

TOKENIZE = f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, len(list_distinct({_WORDS}))::BIGINT AS n_distinct FROM documents"
BENCHMARK_WORDS = """
    WITH raw AS (SELECT item_id, regexp_replace(lower(coalesce(text, '')), 'n''t\\b', ' not', 'g') AS t FROM benchmark),
    part AS (SELECT item_id, flatten(list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''), lambda w: string_split(w, '-'))) AS p FROM raw)
    SELECT item_id, coalesce(array_to_string(list_filter(list_transform(p, lambda w: regexp_replace(regexp_replace(w, '^["'';.:()`,!?]+', ''), '["'';.:()`,!?]+$', '')), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')), ' '), '') AS words FROM part"""
SCAN = f"""
    WITH s AS (SELECT doc_id, len({_WORDS}) AS n FROM documents)
    SELECT count(*)::BIGINT AS total_sentences, sum(n)::BIGINT AS total_words, (count(*) FILTER (WHERE n = 0))::BIGINT AS empty_sentences,
        (max(doc_id) + 1)::BIGINT AS max_index, floor(sum(n) / count(*))::BIGINT AS average_length FROM s"""
VOCAB = f"WITH {_VOCAB} SELECT word, n::BIGINT AS count, r::BIGINT AS index FROM ranked WHERE r < (SELECT count(*) FROM embeddings)"


def averages(weight: str) -> str:
    return f"""
    WITH {_VOCAB}, weighted AS (SELECT word, v, {weight} AS w FROM wv),
    cell AS (SELECT t.idx, generate_subscripts(m.v, 1) - 1 AS dim, unnest(m.v) * m.w AS x FROM tok t JOIN weighted m ON m.word = t.word)
    SELECT idx AS doc_id, dim::BIGINT AS dim, round(sum(x) / count(*), 6) + 0.0 AS value FROM cell GROUP BY idx, dim"""


MANY_TO_ONE = f"""
    WITH sent AS (SELECT row_number() OVER () AS s, conv_id, {_WORDS} AS ws FROM conversations),
    tok AS (SELECT s, conv_id, unnest(ws) AS word FROM sent),
    cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
    ranked AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM cnt),
    wv AS (SELECT k.word, e.embedding::DOUBLE[] AS v FROM ranked k JOIN embeddings e ON e.vec_id = k.r),
    cell AS (SELECT t.s, t.conv_id, generate_subscripts(m.v, 1) - 1 AS dim, unnest(m.v) AS x FROM tok t JOIN wv m ON m.word = t.word),
    each AS (SELECT s, conv_id, dim, avg(x) AS a FROM cell GROUP BY s, conv_id, dim)
    SELECT conv_id, dim::BIGINT AS dim, round(sum(a), 6) + 0.0 AS value FROM each GROUP BY conv_id, dim"""
EFFECTIVE = f"""
    WITH {_VOCAB}, met AS (SELECT t.idx, count(*) AS k FROM tok t JOIN wv USING (word) GROUP BY t.idx)
    SELECT doc_id, coalesce(k, 0)::BIGINT AS known FROM documents LEFT JOIN met ON met.idx = doc_id"""
def truncated(most: int) -> str:
    return f"""
    WITH {_VOCAB}, placed AS (SELECT doc_id AS idx, generate_subscripts({_WORDS}, 1) AS pos, unnest({_WORDS}) AS word FROM documents),
    met AS (SELECT p.idx, m.v, row_number() OVER (PARTITION BY p.idx ORDER BY p.pos) AS k FROM placed p JOIN wv m ON m.word = p.word),
    cell AS (SELECT idx, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM met WHERE k <= {most})
    SELECT idx AS doc_id, dim::BIGINT AS dim, round(avg(x), 6) + 0.0 AS value FROM cell GROUP BY idx, dim"""


EPS_INIT = f"""
    WITH {_VOCAB}, cell AS (SELECT t.idx, generate_subscripts(m.v, 1) - 1 AS dim, unnest(m.v) AS x FROM tok t JOIN wv m ON m.word = t.word),
    means AS (SELECT idx, dim, avg(x) AS a FROM cell GROUP BY idx, dim),
    grid AS (SELECT i.idx, d.dim FROM (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS idx) i, (SELECT unnest(range(64)) AS dim) d)
    SELECT g.idx::BIGINT AS doc_id, g.dim::BIGINT AS dim, round(coalesce(a, 0.0) + {EPS}, 9) + 0.0 AS value FROM grid g LEFT JOIN means m ON m.idx = g.idx AND m.dim = g.dim"""
SIF_WEIGHTS = f"WITH {_VOCAB} SELECT word, round({SIF}, 9) AS weight FROM wv"
USIF_WEIGHTS = f"WITH {_VOCAB} SELECT word, round({USIF}, 9) AS weight FROM wv"
INDUCED = f"""
    WITH {_VOCAB}, en AS (SELECT unnest({_WORDS}) AS word FROM documents WHERE lang = 'en'),
    freq AS (SELECT word, count(*)::DOUBLE / (SELECT count(*) FROM en)::DOUBLE AS f FROM en GROUP BY word)
    SELECT wv.word, floor(coalesce(f, 1e-8) * 2147483647)::BIGINT AS count FROM wv LEFT JOIN freq ON freq.word = wv.word"""

_SV = "sv AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS v, label FROM embeddings)"
_UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"
PAIRS = f"WITH {_SV} SELECT a.idx, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS similarity FROM sv a JOIN sv b ON b.idx = a.idx + 1"
DISTANCES = f"WITH {_SV} SELECT a.idx, round(1 - list_cosine_similarity(a.v, b.v), 6) + 0.0 AS distance FROM sv a JOIN sv b ON b.idx = a.idx + 1"


def _nearest(query: str, where: str, k: int | None, extra: str = "", ctes: str = "") -> str:
    limit = f"ORDER BY s DESC, idx LIMIT {k}" if k else ""
    return f"""
    WITH {ctes}{_SV}, q AS ({query}),
    scored AS (SELECT sv.idx, list_cosine_similarity(sv.v, q.v) AS s FROM sv, q WHERE {where}),
    best AS (SELECT * FROM scored {limit})
    SELECT best.idx, {extra.format("source") if extra else ""}round(s, 6) + 0.0 AS similarity FROM best"""


def similar(weights: dict[int, float], where: str, k: int | None) -> str:
    case = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in weights.items())
    cells = f"""SELECT list(x ORDER BY d) AS v FROM (SELECT d, sum(x) AS x FROM (
        SELECT generate_subscripts(v, 1) AS d, unnest({_UNIT}) * CASE idx {case} END AS x FROM sv WHERE idx IN ({", ".join(map(str, weights))})) GROUP BY d)"""
    return _nearest(cells, where, k)


WITH_TEXT = similar({0: 1}, "idx <> 0", 10).replace("SELECT best.idx, ", "SELECT best.idx, source, ").replace("FROM best", "FROM best JOIN documents ON doc_id = best.idx")
BY_WORD = _nearest("SELECT v FROM wv WHERE r = 0", "TRUE", 10, ctes=_VOCAB + ", ")
BY_SENTENCE = _nearest("SELECT list(x ORDER BY d) AS v FROM (SELECT d, avg(x) AS x FROM (SELECT generate_subscripts(v, 1) AS d, unnest(v) AS x FROM wv WHERE r < 3) GROUP BY d)", "TRUE", 10, ctes=_VOCAB + ", ")
BATCH = f"""
    WITH {_SV}, scored AS (SELECT q.idx AS qid, sv.idx, list_cosine_similarity(q.v, sv.v) AS s FROM sv q, sv WHERE q.idx % 50 = 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, idx) AS rank FROM scored)
    SELECT qid, idx, round(s, 6) + 0.0 AS similarity, rank::BIGINT AS rank FROM placed WHERE rank <= 10"""
UNIT = f"WITH {_SV} SELECT idx, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(unnest({_UNIT}), 6) + 0.0 AS value FROM sv"
LOOKUP = f"""
    WITH {_SV}, asked AS (SELECT * FROM (VALUES (0, 7), (1, 2), (2, 11)) t(position, idx))
    SELECT position::BIGINT AS position, sv.idx, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(unnest(v), 6) AS value FROM asked JOIN sv ON sv.idx = asked.idx"""


def removed(squared: float) -> str:
    return f"""
    WITH {_SV}, c AS (SELECT {_UNIT} AS c FROM sv WHERE idx = 0),
    p AS (SELECT idx, v, c, list_dot_product(v, c) * {squared} AS s FROM sv, c)
    SELECT idx, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(unnest(v) - s * unnest(c), 6) + 0.0 AS value FROM p"""


def _gram(rows: str, parts: int = 1) -> str:
    """CTEs cells(i, j, x), g(rows) and p(k, v, sigma), the first `parts` singular vectors and values of a relation of (idx, v).

    The Gramian is squared 16 times, which leaves no trace of any but its largest eigenvalue; that part is then subtracted for the next."""
    out = f"""long AS MATERIALIZED (SELECT idx, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM {rows}),
    cells AS MATERIALIZED (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) AS x FROM long a JOIN long b ON a.idx = b.idx GROUP BY a.d, b.d),
    g AS MATERIALIZED (SELECT list(row ORDER BY i) AS rows FROM (SELECT i, list(x ORDER BY j) AS row FROM cells GROUP BY i)),
    g0 AS (SELECT rows FROM g)"""
    for k in range(parts):
        out += f""",
    power{k}(step, rows) AS (
        SELECT 0, list_transform(rows, lambda r: list_transform(r, lambda x: x / list_max(list_transform(rows, lambda q: list_max(q))))) FROM g{k} UNION ALL
        SELECT step + 1, list_transform(sq, lambda r: list_transform(r, lambda x: x / top)) FROM (
            SELECT step, sq, list_max(list_transform(sq, lambda q: list_max(q))) AS top FROM (
                SELECT step, list_transform(rows, lambda r: list_transform(rows, lambda q: list_dot_product(r, q))) AS sq FROM power{k} WHERE step < 16))),
    last{k} AS (SELECT rows[list_position(list_transform(rows, lambda r: list_max(r)), list_max(list_transform(rows, lambda r: list_max(r))))] AS v FROM power{k} ORDER BY step DESC LIMIT 1),
    unit{k} AS (SELECT list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM last{k}),
    part{k} AS MATERIALIZED (SELECT {k} AS k, list_transform(v, lambda x: x * CASE WHEN list_max(v) >= -list_min(v) THEN 1.0 ELSE -1.0 END) AS v,
        list_dot_product(v, list_transform(g{k}.rows, lambda r: list_dot_product(r, v))) AS square FROM unit{k}, g{k}),
    g{k + 1} AS MATERIALIZED (SELECT list_transform(rows, lambda r, i: list_transform(r, lambda x, j: x - square * v[i] * v[j])) AS rows FROM g{k}, part{k})"""
    every = " UNION ALL ".join(f"SELECT * FROM part{k}" for k in range(parts))
    return out + f""",
    p AS MATERIALIZED (SELECT k, v, sqrt(square) AS sigma FROM ({every}))"""


_LONG = "long AS MATERIALIZED (SELECT idx, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM sv)"
GRAMIAN = f"WITH {_SV}, {_LONG} SELECT (a.d - 1)::BIGINT AS i, (b.d - 1)::BIGINT AS j, round(sum(a.x * b.x), 4) + 0.0 AS value FROM long a JOIN long b ON a.idx = b.idx GROUP BY a.d, b.d"
SVD = f"WITH RECURSIVE {_SV}, {_gram('sv')} SELECT (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(sigma, 5) AS sigma, round(unnest(v), 5) + 0.0 AS value FROM p"
SVD_FIVE = f"WITH RECURSIVE {_SV}, {_gram('sv', 5)} SELECT k::BIGINT AS component, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(sigma, 4) AS sigma, round(unnest(v), 4) + 0.0 AS value FROM p"


def _raw(weight: str, parts: int) -> str:
    """CTEs of the sentence vectors before the removal of components, and these."""
    return f"""{_VOCAB}, weighted AS (SELECT word, v, {weight} AS w FROM wv),
    cell AS (SELECT t.idx, generate_subscripts(m.v, 1) AS d, unnest(m.v) * m.w AS x FROM tok t JOIN weighted m ON m.word = t.word),
    means AS (SELECT idx, d, sum(x) / count(*) AS a FROM cell GROUP BY idx, d),
    grid AS (SELECT i.idx, k.d FROM (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS idx) i, (SELECT unnest(range(1, 65)) AS d) k),
    raw AS MATERIALIZED (SELECT idx, list(x ORDER BY d) AS v FROM (SELECT g.idx, g.d, coalesce(a, 0.0) + {EPS} AS x FROM grid g LEFT JOIN means m ON m.idx = g.idx AND m.d = g.d) GROUP BY idx),
    {_gram('raw', parts)}"""


SIF_EMBEDDING = f"""
    WITH RECURSIVE {_raw(SIF, 1)}, o AS (SELECT idx, raw.v, p.v AS c, list_dot_product(raw.v, p.v) AS s FROM raw, p)
    SELECT idx::BIGINT AS doc_id, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(unnest(v) - s * unnest(c), 5) + 0.0 AS value FROM o"""
USIF_EMBEDDING = f"""
    WITH RECURSIVE {_raw(USIF, 5)},
    share AS (SELECT k, v AS c, pow(sigma * sigma / sum(sigma * sigma) OVER (), 2) AS w FROM p),
    o AS (SELECT idx, generate_subscripts(c, 1) - 1 AS dim, list_dot_product(raw.v, c) * w * unnest(c) AS x FROM raw, share),
    less AS (SELECT idx, dim, sum(x) AS x FROM o GROUP BY idx, dim)
    SELECT idx::BIGINT AS doc_id, dim::BIGINT AS dim, round(raw.v[dim + 1] - x, 5) + 0.0 AS value FROM less JOIN raw USING (idx)"""
SIF_INFER = f"""
    WITH RECURSIVE {_raw(SIF, 1)}, item AS ({_tokens('benchmark', 'item_id')}),
    icell AS (SELECT t.idx, generate_subscripts(m.v, 1) AS d, unnest(m.v) * m.w AS x FROM item t JOIN weighted m ON m.word = t.word),
    imean AS (SELECT idx, d, sum(x) / count(*) AS a FROM icell GROUP BY idx, d),
    ivec AS (SELECT idx, list(x ORDER BY d) AS v FROM (SELECT b.item_id AS idx, k.d, coalesce(a, 0.0) AS x FROM benchmark b CROSS JOIN (SELECT unnest(range(1, 65)) AS d) k LEFT JOIN imean m ON m.idx = b.item_id AND m.d = k.d) GROUP BY idx),
    o AS (SELECT idx, ivec.v, p.v AS c, list_dot_product(ivec.v, p.v) AS s FROM ivec, p)
    SELECT idx AS item_id, (generate_subscripts(v, 1) - 1)::BIGINT AS dim, round(unnest(v) - s * unnest(c), 5) + 0.0 AS value FROM o"""
APPENDED = f"""
    WITH {_VOCAB}, every AS (SELECT idx, word FROM tok UNION ALL SELECT idx + (SELECT max(doc_id) + 1 FROM documents), word FROM ({_tokens('benchmark', 'item_id')})),
    cell AS (SELECT t.idx, generate_subscripts(m.v, 1) - 1 AS dim, unnest(m.v) AS x FROM every t JOIN wv m ON m.word = t.word),
    means AS (SELECT idx, dim, avg(x) AS a FROM cell GROUP BY idx, dim),
    home AS (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS idx, {EPS} AS e UNION ALL SELECT item_id + (SELECT max(doc_id) + 1 FROM documents), 0.0 FROM benchmark)
    SELECT h.idx::BIGINT AS idx, d.dim::BIGINT AS dim, round(coalesce(a, 0.0) + e, 6) + 0.0 AS value FROM home h CROSS JOIN (SELECT unnest(range(64)) AS dim) d LEFT JOIN means m ON m.idx = h.idx AND m.dim = d.dim"""
LINES = "SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, translate(text, chr(13) || chr(10) || chr(9), '   ') AS text FROM benchmark"
SENTENCE_PAIRS = """
    WITH t AS (SELECT item_id, translate(text, chr(13) || chr(10) || chr(9), '   ') AS t FROM benchmark)
    SELECT row_number() OVER (ORDER BY a.item_id) - 1 AS row, (a.item_id % 6)::DOUBLE / 4 AS score, a.t AS sentence1, b.t AS sentence2 FROM t a JOIN t b ON b.item_id = a.item_id + 1"""

_GRAMS = """flatten(list_transform(range(1, length(e) + 1), lambda i: list_transform(list_filter(range(3, 7), lambda n: i + n - 1 <= length(e)), lambda n: substr(e, i, n))))"""
NGRAMS = f"""
    WITH w AS (SELECT DISTINCT '<' || word || '>' AS e FROM ({_tokens()}))
    SELECT gram, count(*)::BIGINT AS n_words FROM (SELECT unnest(list_distinct({_GRAMS})) AS gram FROM w) GROUP BY gram"""


def _fnv(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * k - 1, 2))::BIGINT"
    return f"""list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, (length(hex(encode({text}))) // 2) + 1), lambda k: {byte} + CASE WHEN {byte} >= 128 THEN 4294967040 ELSE 0 END)),
        lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""


HASHES = f"""
    WITH w AS (SELECT DISTINCT '<' || word || '>' AS e FROM ({_tokens()})), grams AS (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM w)
    SELECT gram, {_fnv('gram')}::BIGINT AS hash FROM grams"""


def subword(table: str, key: str) -> str:
    return f"""
    WITH {_VOCAB}, item AS MATERIALIZED (SELECT {key}, unnest({_WORDS}) AS word FROM {table}),
    size AS (SELECT {key}, count(*) AS n FROM item GROUP BY {key}),
    counted AS MATERIALIZED (SELECT {key}, word, count(*) AS tf FROM item GROUP BY {key}, word),
    known AS (SELECT t.{key}, generate_subscripts(m.v, 1) AS d, unnest(m.v) * tf AS x FROM counted t JOIN wv m ON m.word = t.word),
    lost AS (SELECT {key}, c.word, tf FROM counted c ANTI JOIN wv ON wv.word = c.word),
    words AS (SELECT word, '<' || word || '>' AS e FROM (SELECT DISTINCT word FROM lost)),
    grams AS (SELECT word, {_GRAMS}[1:40] AS gs FROM words),
    placed AS MATERIALIZED (SELECT word, len(gs) AS k, unnest(gs) AS gram FROM grams),
    hashed AS MATERIALIZED (SELECT gram, {_fnv('gram')} % (SELECT count(*) FROM embeddings) AS b FROM (SELECT DISTINCT gram FROM placed)),
    made AS (SELECT {key}, b, sum(tf / k::DOUBLE) AS w FROM lost JOIN placed USING (word) JOIN hashed USING (gram) GROUP BY {key}, b),
    mcell AS (SELECT {key}, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE * w AS x FROM made JOIN embeddings ON vec_id = b),
    cell AS (SELECT * FROM known UNION ALL SELECT * FROM mcell)
    SELECT b.{key}, (k.d - 1)::BIGINT AS dim, round(coalesce(s / n, 0.0), 6) + 0.0 AS value
    FROM {table} b CROSS JOIN (SELECT unnest(range(1, 65)) AS d) k LEFT JOIN (SELECT {key}, d, sum(x) AS s FROM cell GROUP BY {key}, d) c ON c.{key} = b.{key} AND c.d = k.d LEFT JOIN size z ON z.{key} = b.{key}"""


PEARSON = f"""
    WITH {_SV} SELECT round(corr(list_cosine_similarity(a.v, b.v), (a.label = b.label)::INT::DOUBLE) * 100, 5) AS pearson FROM sv a JOIN sv b ON b.idx = a.idx + 1"""
