"""DuckDB SQL for the queries that SQL can express."""

# n_repeat_words: words inside any 5-word window that occurs twice or more in the text.
OP10 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (
  SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), ln AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n, count(*) AS lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), c AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(ln.lines, 0) AS BIGINT) AS n_lines
  FROM w LEFT JOIN ln USING (rid) LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * n_symbols > 20 * word_chars AS symbols,
    100 * n_dup_lines > 30 * n_lines AS lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length FROM c
), j AS (
  SELECT source, unnest(['base', 'symbols', 'lines', 'word_length']) AS rule, unnest([base_failed, symbols, lines, word_length])::INT::DOUBLE AS failed FROM f
), h AS (
  SELECT source, rule, count(*) AS n, sum(failed) AS x FROM j GROUP BY source, rule
), v AS (
  SELECT rule, sum(x) / sum(n) AS m, (sum(x * x / n) - sum(x) * sum(x) / sum(n) - (count(*) - 1) * (sum(x) / sum(n)) * (1 - sum(x) / sum(n))) / sum(n) AS between_hosts FROM h GROUP BY rule
), k AS (
  SELECT rule, m, CASE WHEN between_hosts > 0 THEN least(greatest(m * (1 - m) / between_hosts - 1, 1), 1e6) ELSE 1e6 END AS k FROM v
), r AS (
  SELECT source, rule, n, m, k, (x + m * k) / (n + k) AS rate FROM h JOIN k USING (rule)
), s AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + k + 1)) > greatest(0.25, least(0.9, 2 * m))) AS rejected,
    max(rate) FILTER (WHERE rule = 'base') AS a, max(rate) FILTER (WHERE rule = 'symbols') AS b, max(rate) FILTER (WHERE rule = 'lines') AS c, max(rate) FILTER (WHERE rule = 'word_length') AS d
  FROM r GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND NOT rejected AS kept,
  f.source AS host, round(a, 6) AS host_base_rate, round(b, 6) AS host_symbols_rate, round(c, 6) AS host_lines_rate, round(d, 6) AS host_word_length_rate
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
  top AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d),
  r AS (SELECT p.*, CASE WHEN page_id IS DISTINCT FROM m AND m IS NOT NULL THEN m END AS refers_to FROM p LEFT JOIN top USING (d))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  CASE WHEN refers_to IS NULL THEN greatest(1, CAST(ceil(n / 262144.0) AS INT)) ELSE 1 END AS n_chunks
FROM r
"""



def _op3() -> str:
    """The known sentences and rules as values, the rest as SQL of its own."""
    from actionflow.llm.license_scan import ANCHORS, LOWER, RULES, UPPER, known_sentences

    known = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    rules = ", ".join("('{}', '% {} %', {})".format(n, " % ".join(w), f"'% {u[0]} %'" if u else "NULL") for n, w, u in RULES)
    anchors = " OR ".join(f"contains(translate(t, '{UPPER}', '{LOWER}'), '{a}')" for a in ANCHORS)
    ids = lambda cut: f"""(
  SELECT rid, string_agg(i, '  ' ORDER BY n) AS ids, count(*) AS many FROM (
    SELECT rid, n, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM (
      SELECT rid, unnest(l) AS s, unnest(range(len(l))) AS n FROM (SELECT rid, string_split(regexp_replace({cut}, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS l FROM d WHERE anchored)))
  JOIN known USING (s) GROUP BY rid)"""  # noqa: E731
    joined = "regexp_replace(regexp_replace(regexp_replace(t, ':[ \\t\\r]*\\n', ':. ', 'g'), '\\n[ \\t\\r]*\\n', '. ', 'g'), '[ \\t\\r]*\\n[^a-zA-Z0-9\\n]*', ' ', 'g')"
    return f"""
WITH known(s, i) AS (VALUES {known}), rules(licence, wanted, unwanted) AS (VALUES {rules}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, t, {anchors} AS anchored FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
a AS {ids("t")}, b AS {ids(joined)},
c AS (SELECT d.rid, doc_id, CASE WHEN coalesce(a.many, 0) >= coalesce(b.many, 0) THEN coalesce(a.ids, '') ELSE b.ids END AS ids, greatest(coalesce(a.many, 0), coalesce(b.many, 0)) AS many
  FROM d LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)),
m AS (SELECT rid, string_agg(DISTINCT licence, ' ' ORDER BY licence) AS licenses FROM c JOIN rules ON ' ' || ids || ' ' LIKE wanted AND NOT coalesce(' ' || ids || ' ' LIKE unwanted, false) GROUP BY rid)
SELECT doc_id, CAST(many AS BIGINT) AS n_sentences, replace(ids, '  ', ' ') AS sentence_ids, coalesce(licenses, '') AS licenses FROM c LEFT JOIN m USING (rid)
"""


# Pairs that share a shingle, counted; then what can be reached from each document.
OP8 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d)
), n AS MATERIALIZED (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), p AS (
  SELECT a.rid AS u, b.rid AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid
), e AS MATERIALIZED (
  SELECT u, v FROM p JOIN n x ON x.rid = u JOIN n y ON y.rid = v WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), r(a, b) AS (
  SELECT rid, rid FROM d UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u
), c AS (
  SELECT a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = b GROUP BY a
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""

OP1 = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding[1:64], lambda x: x >= 0) AS s FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) >= 64 AND len(list_filter(embedding[1:64], lambda x: x IS NULL)) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(len(list_filter(list_zip(q.s, r.s), lambda z: z[1] <> z[2])) AS BIGINT) AS distance
  FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM p
QUALIFY rank <= 10
"""

ORACLES = {"op1_hamming_top_k": OP1, "op3_license_scan": _op3(), "op7_warc_chunks": OP7, "op8_minhash_near_duplicates": OP8, "op10_quality_rules": OP10}
