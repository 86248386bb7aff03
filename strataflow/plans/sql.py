"""Building blocks of the SQL that gives the same rows as the registered queries."""

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def chunks_of(condition: str) -> str:
    """chunks(doc_id, sequence, content): the greedy merge as a walk over the pieces of each document that meets a condition."""
    return rf"""
ps AS (SELECT doc_id, regexp_split_to_array(text, '[\n。；！？]') AS p FROM documents WHERE text IS NOT NULL AND {condition}),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM ps),
walk AS (
  SELECT doc_id, i, 1 AS seq, length(piece) // 2 AS n, piece = '' AS blank FROM pieces WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.blank OR w.n > 256 THEN w.seq + 1 ELSE w.seq END,
    CASE WHEN w.blank OR w.n > 256 THEN length(p.piece) // 2 ELSE w.n + length(p.piece) // 2 END,
    CASE WHEN w.blank OR w.n > 256 THEN p.piece = '' ELSE FALSE END
  FROM walk w JOIN pieces p ON p.doc_id = w.doc_id AND p.i = w.i + 1
),
chunks AS MATERIALIZED (
  SELECT doc_id, seq AS sequence, string_agg(piece, '' ORDER BY w.i) AS content
  FROM walk w JOIN pieces p USING (doc_id, i) GROUP BY doc_id, seq HAVING regexp_matches(string_agg(piece, '' ORDER BY w.i), '\S')
)"""


CHUNKS = chunks_of("TRUE")


#: tok(doc_id, sequence, term), tf, lens, stats (with the floor of negative idf), avgdl.
KEYWORDS = (
    """
tok AS (SELECT doc_id, sequence, unnest("""
    + TOKENS.format("content")
    + """) AS term FROM chunks),
tf AS MATERIALIZED (SELECT doc_id, sequence, term, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id, sequence, sum(tf)::DOUBLE AS dl FROM tf GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE AS n FROM chunks),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, total),
mean AS (SELECT avg(raw) AS mean FROM raw),
stats AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean),
avgdl AS (SELECT avg(dl) AS avgdl FROM lens)"""
)

QUERY_TERMS = (
    """
qtok AS (SELECT item_id AS query_id, unnest("""
    + TOKENS.format("text")
    + """) AS term FROM benchmark WHERE text IS NOT NULL),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM qtok GROUP BY ALL)"""
)

BM25 = """
kw AS (
  SELECT query_id, doc_id, sequence, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS kw
  FROM tf JOIN qtf USING (term) JOIN stats USING (term) JOIN lens USING (doc_id, sequence), avgdl GROUP BY ALL
)"""


def search_among(condition: str) -> str:
    """Cosines of hashed embeddings, with the 125 best chunks of each query of those that meet a condition."""
    return f"""
cb AS (SELECT doc_id, sequence, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf)::DOUBLE AS v FROM tf GROUP BY ALL),
cn AS (SELECT doc_id, sequence, sqrt(sum(v * v)) AS norm FROM cb GROUP BY ALL),
qb AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(qtf)::DOUBLE AS v FROM qtf GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS norm FROM qb GROUP BY ALL),
queries AS (SELECT item_id AS query_id FROM benchmark),
dots AS (SELECT query_id, doc_id, sequence, sum(qb.v * cb.v) AS d FROM qb JOIN cb USING (b) GROUP BY ALL),
cosines AS (
  SELECT q.query_id, c.doc_id, c.sequence, round(coalesce(d / (qn.norm * cn.norm), 0), 9) AS vec
  FROM queries q CROSS JOIN chunks c LEFT JOIN dots USING (query_id, doc_id, sequence) LEFT JOIN qn USING (query_id) LEFT JOIN cn USING (doc_id, sequence)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, doc_id, sequence) AS r FROM cosines WHERE {condition}),
hits AS (SELECT * FROM ranked WHERE r <= 125)"""


SEARCH = search_among("TRUE")

#: The same with two sub-queries, the query and its five keywords; hits are fused, kw is the better of both.
SUB_QUERIES = """
xw AS (SELECT query_id, term, round(qtf * idf, 6) AS weight FROM qtf JOIN stats USING (term)),
xr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank FROM xw),
sq AS (SELECT query_id, 0 AS sub, term, qtf FROM qtf UNION ALL SELECT query_id, 1, term, 1 FROM xr WHERE rank <= 5),
subs AS (SELECT item_id AS query_id, 0 AS sub FROM benchmark UNION SELECT query_id, sub FROM sq),
cb AS (SELECT doc_id, sequence, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf)::DOUBLE AS v FROM tf GROUP BY ALL),
cn AS (SELECT doc_id, sequence, sqrt(sum(v * v)) AS norm FROM cb GROUP BY ALL),
qb AS (SELECT query_id, sub, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(qtf)::DOUBLE AS v FROM sq GROUP BY ALL),
qn AS (SELECT query_id, sub, sqrt(sum(v * v)) AS norm FROM qb GROUP BY ALL),
dots AS (SELECT query_id, sub, doc_id, sequence, sum(qb.v * cb.v) AS d FROM qb JOIN cb USING (b) GROUP BY ALL),
cosines AS (
  SELECT q.query_id, q.sub, c.doc_id, c.sequence, round(coalesce(d / (qn.norm * cn.norm), 0), 9) AS vec
  FROM subs q CROSS JOIN chunks c LEFT JOIN dots USING (query_id, sub, doc_id, sequence) LEFT JOIN qn USING (query_id, sub) LEFT JOIN cn USING (doc_id, sequence)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY vec DESC, doc_id, sequence) AS r FROM cosines),
fused AS (
  SELECT query_id, doc_id, sequence, arg_min(vec, sub * 1000 + r) AS vec, round(sum(1 / (60.0 + r)), 12) AS rrf, min(sub * 1000 + r) AS seen
  FROM ranked WHERE r <= 125 GROUP BY ALL
),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen) AS r FROM fused),
kws AS (
  SELECT query_id, sub, doc_id, sequence, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS kw
  FROM tf JOIN sq USING (term) JOIN stats USING (term) JOIN lens USING (doc_id, sequence), avgdl GROUP BY ALL
),
kw AS (SELECT query_id, doc_id, sequence, max(kw) AS kw FROM kws GROUP BY ALL)"""


def RERANK(source: str, name: str) -> str:  # noqa: N802
    return f"""
{name}_kw AS (SELECT h.query_id, h.doc_id, h.sequence, h.r, h.vec, greatest(0, coalesce(kw, 0)) AS raw FROM {source} h LEFT JOIN kw USING (query_id, doc_id, sequence)),
{name}_mm AS (SELECT *, CASE WHEN max(raw) OVER q - min(raw) OVER q > 1e-6 THEN (raw - min(raw) OVER q) / (max(raw) OVER q - min(raw) OVER q) ELSE 0 END AS kws FROM {name}_kw WINDOW q AS (PARTITION BY query_id)),
{name}_sc AS (SELECT *, round(vec * 0.8 + kws * 0.2, 9) AS score FROM {name}_mm),
{name}_rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, doc_id, sequence) AS rank FROM {name}_sc WHERE score >= 0.6),
{name} AS (SELECT query_id, doc_id, sequence, rank, score, vec, kws FROM {name}_rk WHERE rank <= 5)"""


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
