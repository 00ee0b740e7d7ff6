"""DuckDB SQL for the queries of plans.queries."""

from __future__ import annotations

from actionflow.plans import catalog_oracles, file_oracles

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', '')"
EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
BASE = "regexp_extract(path, '([^/]*)$', 1)"
PAGES = f"p AS (SELECT page_id, {PATH} AS path FROM pages), f AS (SELECT page_id, path, {EXT} AS ext, {BASE} AS base FROM p), n AS (SELECT *, CASE WHEN ends_with(lower(base), ext) THEN left(base, length(base) - length(ext)) ELSE base END AS name FROM f)"

CATALOG = """c AS (SELECT p_partkey AS id, p_name AS name, p_brand AS alias, lower(p_type) AS description, p_type, p_type = 'LARGE' AS is_meta,
  CASE p_size % 4 WHEN 0 THEN ['*'] WHEN 1 THEN ['.png', '.jpg'] WHEN 2 THEN [] ELSE ['.HEIC'] END AS types,
  CASE p_type WHEN 'ECONOMY' THEN 800 WHEN 'STANDARD' THEN 700 WHEN 'SMALL' THEN 650 WHEN 'MEDIUM' THEN 600 WHEN 'LARGE' THEN 550 ELSE 0 END AS boost FROM part)"""
USAGE = f"""l AS (SELECT user_id AS id, count(*) AS count, max(ts) AS last_used FROM events GROUP BY user_id),
u AS (SELECT *, greatest(0, (epoch_us({AS_OF}) - epoch_us(last_used)) / 86400e6) AS age FROM l),
b AS (SELECT id, count, last_used, count * 400 * exp(-ln(2) / 14 * age) + CASE WHEN age < 1 THEN 250 ELSE 0 END AS boost FROM u)"""


def fuzzy(q: str) -> str:
    return f"CASE WHEN lower(name) = '{q}' THEN 900 WHEN starts_with(lower(name), '{q}') THEN 700 WHEN contains(lower(name), '{q}') THEN 450 ELSE greatest(0, 1 - levenshtein(lower(name), '{q}') / greatest(strlen(name), {len(q)})) * 400 END"


def types(given: list[str]) -> str:
    low = "[" + ", ".join(f"'{g.lower()}'" for g in given) + "]"
    return f"CASE WHEN len(types) = 0 THEN {str(not given).lower()} WHEN list_contains(types, '*') THEN true ELSE list_has_any(list_transform(types, lambda x: lower(x)), {low}::VARCHAR[]) END"


def match(q: str) -> str:
    words = " OR ".join(f"len(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: starts_with(w, '{w}'))) > 0" for w in q.split())
    return f"(contains(lower(name), '{q}') OR contains(lower(alias), '{q}') OR contains(description, '{q}') OR {words} OR levenshtein(lower(name), '{q}') <= 2)"


STEPS = "s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)"
TURNS = "s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
PERMS = "['tools.exec', '', 'network', 'files.read', 'system', 'tools.exec']"
JSON_K = "json_extract_string(props, '$.k')"

ORACLES = {
    "search_ranked": f"""WITH {CATALOG}, {USAGE}, f AS (SELECT c.*, b.boost AS used FROM c LEFT JOIN b USING (id) WHERE {match("cold wiget")} AND (is_meta OR {types([".png"])}))
SELECT id, name, round(boost + {fuzzy("cold wiget")} + CASE WHEN starts_with(lower(alias), 'cold wiget') THEN 500 ELSE 0 END + CASE WHEN {types([".png"])} THEN 600 ELSE 0 END + coalesce(used, 0), 6) AS score
FROM f ORDER BY boost + {fuzzy("cold wiget")} + CASE WHEN {types([".png"])} THEN 600 ELSE 0 END + coalesce(used, 0) DESC, name, id LIMIT 6""",
    "search_empty_query": f"WITH {CATALOG}, {USAGE} SELECT id, name, round(c.boost + CASE WHEN {types([])} THEN 600 ELSE 0 END + coalesce(b.boost, 0), 6) AS score FROM c LEFT JOIN b USING (id)",
    "search_with_types": f"WITH {CATALOG} SELECT id, name, round(boost + {fuzzy('brand#1')} + CASE WHEN starts_with(lower(alias), 'brand#1') THEN 500 ELSE 0 END + CASE WHEN {types(['.heic', '.png'])} THEN 600 ELSE 0 END, 6) AS score FROM c WHERE {match('brand#1')} AND (is_meta OR {types(['.heic', '.png'])})",
    "fuzzy_score": f"WITH {CATALOG} SELECT id, round(CAST({fuzzy('small bolt')} AS DOUBLE), 6) AS score, levenshtein(lower(name), 'small bolt') AS distance FROM c",
    "text_match": f"WITH {CATALOG} SELECT id, name FROM c WHERE {match('hot wid')}",
    "input_match": f"WITH {CATALOG} SELECT id, {types(['.heic'])} AS heic, {types(['.png', '.bmp'])} AS png, {types([])} AS nothing FROM c",
    "alias_match": f"WITH {CATALOG} SELECT id, starts_with(lower(alias), 'brand#1') AS matched FROM c",
    "frecency": f"WITH {USAGE} SELECT id, count, last_used, round(boost, 6) AS boost FROM b",
    "usage_counts": "SELECT event_type AS skill_id, count(*) AS count, max(ts) AS last_used FROM events GROUP BY event_type",
    "layer_merge": """WITH r AS (SELECT c_nationkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS layer, c_name AS definition_path FROM customer
UNION ALL SELECT s_nationkey, 2, s_name FROM supplier WHERE s_nationkey % 3 = 0)
SELECT id, CAST(layer AS INT) AS layer, definition_path FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer DESC, definition_path DESC) = 1""",
    "permission_normalize": f"""WITH h AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter({PERMS}[1:p_size % 6 + 1], lambda x: x <> ''))) AS p FROM part),
e AS (SELECT *, list_filter(p, lambda x: x IN ('files.anywhere', 'network', 'tools.exec.any', 'system')) AS v FROM h)
SELECT id, coalesce(array_to_string(p, ','), '') AS permissions, coalesce(array_to_string(v, ','), '') AS elevated, len(v) > 0 AS needs_trust FROM e""",
    "file_identity": f"WITH {PAGES} SELECT page_id, name, ext, regexp_replace(path, '/[^/]*$', '') AS folder FROM n",
    "distinct_types": f"WITH {PAGES} SELECT DISTINCT ext FROM f",
    "last_step": f"WITH {STEPS} SELECT l_orderkey, max_by(l_returnflag, i) AS l_returnflag, count(*) AS steps FROM s GROUP BY l_orderkey",
    "remove_step": f"WITH {TURNS} SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS step_index FROM s WHERE i <> 1",
    "replay_fold": f"""WITH {STEPS}, e AS (SELECT l_orderkey, i, CASE l_returnflag WHEN 'A' THEN '.png' WHEN 'R' THEN '.jpg' ELSE '' END AS e FROM s),
g AS (SELECT l_orderkey, list_prepend('.heic', list(e ORDER BY i)) AS chain FROM e GROUP BY l_orderkey)
SELECT l_orderkey, CAST(len(chain) - 1 AS BIGINT) AS steps, list_reduce(chain, lambda a, x: CASE WHEN x = '' THEN a ELSE x END) AS final_extension FROM g""",
    "selection_range": "SELECT doc_id AS id, source FROM documents WHERE doc_id BETWEEN 40 AND 120",
    "selection_invert": "SELECT doc_id AS id, n_chars FROM documents WHERE NOT n_chars > 1000",
    "selection_toggle": "SELECT doc_id AS id FROM documents WHERE (n_chars > 1000) <> (source = 'src0')",
    "upsert_files": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS size FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier) UNION ALL SELECT s_suppkey * 3, s_name, s_acctbal FROM supplier",
    "export_name": f"""WITH {PAGES}, a AS (SELECT page_id, name, ltrim(ext, '.') AS ext, CASE page_id % 3 WHEN 0 THEN 'heic_to_jpeg' WHEN 1 THEN 'blur' ELSE 'file' END AS action,
  CASE page_id % 4 WHEN 0 THEN '{{name}}_{{skill}}.{{ext}}' WHEN 1 THEN '{{name}}' WHEN 2 THEN '{{name}}-{{ext}}' ELSE '{{skill}}.{{ext}}' END AS pattern FROM n),
r AS (SELECT page_id, ext, replace(replace(replace(pattern, '{{name}}', name), '{{ext}}', ext), '{{skill}}', action) AS name FROM a)
SELECT page_id, CASE WHEN contains(name, '.') THEN name ELSE name || '.' || ext END AS name FROM r""",
    # no name here ends in -number, so the greedy assignment is a count of earlier equal names and of a taken one
    "export_collision": f"""WITH {PAGES}, a AS (SELECT page_id, regexp_extract(path, '^/([^/]*)', 1) AS folder, regexp_extract(path, '/([a-z]+)/', 1) AS name FROM p),
t AS (SELECT DISTINCT folder, name FROM a WHERE page_id % 100 = 0),
k AS (SELECT a.*, row_number() OVER (PARTITION BY a.folder, a.name ORDER BY page_id) - 1 + CASE WHEN t.name IS NULL THEN 0 ELSE 1 END AS k FROM a LEFT JOIN t ON a.folder = t.folder AND a.name = t.name)
SELECT page_id, folder, name || CASE WHEN k = 0 THEN '' ELSE '-' || k END || '.html' AS resolved FROM k""",
    "output_ext": "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 2 THEN '.jpg' WHEN p_size % 2 = 0 AND p_size % 5 <> 0 THEN '.wav' ELSE '.png' END AS ext FROM part",
    "param_coerce": f"""WITH k AS (SELECT event_id, props, coalesce(TRY_CAST({JSON_K} AS DOUBLE), 90) AS k FROM events)
SELECT event_id, CASE WHEN props IS NOT NULL THEN k END AS number, CAST(greatest(40, least(100, trunc(k))) AS INT) AS quality, CAST(7.5 AS DOUBLE) AS fallback FROM k""",
    "param_merge": f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '5' ELSE {JSON_K} END AS q, '2' AS r, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END AS s, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS entries FROM events",
    "template_render": "SELECT p_partkey AS id, '/in/' || p_name || ' -q ' || p_size || ' /out ' || p_brand || p_size || ' {{missing}}' AS line FROM part",
    "resize_dims": "WITH d AS (SELECT p_partkey AS id, p_size * 13 AS w, p_partkey % 30 - 3 AS percent FROM part) SELECT id, CASE WHEN percent > 0 THEN CAST(trunc(greatest(1, w * percent / 100)) AS INT) ELSE -1 END AS width, CASE WHEN percent > 0 THEN CAST(trunc(greatest(1, 3 * percent / 100)) AS INT) ELSE -1 END AS height FROM d",
    "color_parse": """WITH h AS (SELECT n_nationkey AS k, lpad(lower(to_hex(n_nationkey::BIGINT * 31337)), 6, '0') AS h FROM nation),
g AS (SELECT k, h, CASE k % 4 WHEN 0 THEN '#' || h WHEN 1 THEN '#' || right(h, 3) WHEN 2 THEN 'rgb(' || k * 12 || ', 2, 3)' ELSE k || ' ' || k * 2 || ' ' || k * 3 END AS given,
  CASE k % 4 WHEN 0 THEN h WHEN 1 THEN h[4] || h[4] || h[5] || h[5] || h[6] || h[6] END AS six FROM h),
c AS (SELECT k, given, CASE WHEN six IS NOT NULL THEN ('0x' || six[1:2])::INT WHEN k % 4 = 2 THEN k * 12 ELSE k END AS r, CASE WHEN six IS NOT NULL THEN ('0x' || six[3:4])::INT WHEN k % 4 = 2 THEN 2 ELSE k * 2 END AS g, CASE WHEN six IS NOT NULL THEN ('0x' || six[5:6])::INT WHEN k % 4 = 2 THEN 3 ELSE k * 3 END AS b FROM g)
SELECT k AS id, given, CASE WHEN r <= 255 THEN r ELSE -1 END AS r, CASE WHEN r <= 255 THEN g ELSE -1 END AS g, CASE WHEN r <= 255 THEN b ELSE -1 END AS b, CASE WHEN r <= 255 THEN CAST(floor(r * 0.85::DOUBLE + 0.5) AS INT) ELSE -1 END AS dark FROM c""",
    "preset_cycle": "SELECT p_partkey AS id, ([90, 75, 50, 25])[coalesce(list_position([90, 75, 50, 25], p_size * 5), 0) % 4 + 1] AS next FROM part",
    "typed_entry": "SELECT p_partkey AS id, p_size::VARCHAR AS int, p_size || 'px' AS string FROM part",
    "truncate_path": f"WITH {PAGES}, s AS (SELECT page_id, path, string_split(path, '/') AS x FROM p) SELECT page_id, CASE WHEN path = '' THEN 'Same as original' WHEN len(x) <= 3 THEN path ELSE '.../' || x[len(x) - 1] || '/' || x[len(x)] END AS short FROM s",
    "snapshot_names": f"WITH {TURNS} SELECT conv_id, turn, printf('snapshot-%03d.png', i) AS name FROM s",
    "action_labels": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_type || '_' || p_size, '_', ' ') END AS label, (p_partkey % 3) || CASE WHEN p_partkey % 3 = 1 THEN ' file' ELSE ' files' END AS message FROM part",
    "copied_names": "SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation",
    "usage_stream": "SELECT event_type AS skill_id, count(*) AS count, max(ts) AS last_used FROM events GROUP BY event_type",
}
ORACLES |= catalog_oracles.ORACLES | file_oracles.ORACLES
