"""DuckDB SQL for the queries of plans.file_queries."""

from __future__ import annotations

# Every raster's pixels in SQL: scaled, its turned copy and its inverse as the three channels.
PIXELS = """e AS (SELECT vec_id AS id, list_transform(embedding[1:64], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
m AS (SELECT id, v, list_min(v) AS lo, greatest(list_max(v) - list_min(v), 1e-9) AS span FROM e),
g AS (SELECT id, list_transform(v, lambda x: CAST(greatest(0, least(255, round_even((x - lo) / span * 255, 0))) AS BIGINT)) AS g FROM m),
px AS (SELECT id, g[i + 1] AS a, g[(i % 8) * 8 + i // 8 + 1] AS b, 255 - g[i + 1] AS c FROM g, (SELECT unnest(range(0, 64)) AS i)),
s AS (SELECT id, CAST(sum(a + b + c) AS BIGINT) AS plain, CAST(sum((299 * a + 587 * b + 114 * c + 500) // 1000) AS BIGINT) AS grey FROM px GROUP BY id)"""

PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', '')"

ORACLES = {
    "mode_targets": """SELECT 'selected' AS rule, doc_id AS id FROM documents WHERE n_chars > 3000 UNION ALL SELECT 'active', doc_id FROM documents WHERE doc_id = 5
UNION ALL SELECT 'batch', doc_id FROM documents UNION ALL SELECT 'all', doc_id FROM documents""",
    "selection_counts": "SELECT 'selected' AS rule, count(DISTINCT doc_id) AS selected FROM documents WHERE n_chars > 3000 UNION ALL SELECT 'active', 1 UNION ALL SELECT 'nothing', 0",
    "public_view": "SELECT doc_id AS id, doc_id AS position, source AS name, '.txt' AS current_extension, n_chars AS size FROM documents",
    "files_by_id": "SELECT doc_id AS id, doc_id AS position, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "files_appended": "SELECT c_custkey AS id, c_custkey AS position, c_name AS name FROM customer UNION ALL SELECT -s_suppkey, s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_name FROM supplier",
    "files_removed": "SELECT doc_id AS id, doc_id AS position FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "first_error": "SELECT 'no codec for ' || arg_min(url, page_id) AS error FROM pages WHERE contains(url, '?')",
    "previous_step": """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, printf('snapshot-%03d.png', max(i)) AS start_from, CAST(max(i) AS INT) AS step_index FROM s WHERE i < 2 GROUP BY conv_id""",
    "snapshot_list": """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
k AS (SELECT conv_id, greatest(max(CASE WHEN i IN (0, 2, 3) THEN i END), CASE WHEN conv_id % 2 = 0 THEN 5 ELSE 0 END) AS last, list(i) AS had FROM s GROUP BY conv_id),
x AS (SELECT conv_id, had, unnest(range(0, last + 1)) AS i FROM k)
SELECT conv_id, CAST(i AS INT) AS step_index, CASE WHEN i = 0 THEN 'again.png' WHEN i = 5 THEN 'late.png' WHEN i IN (2, 3) AND list_contains(had, i) THEN printf('snapshot-%03d.png', i) END AS snapshot FROM x""",
    "timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS applied_at, strftime(ts, '%Y%m%d-%H%M%S') AS workspace FROM events",
    "preset_labels": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'V' WHEN 2 THEN 'L' ELSE '' END || event_type AS value, CASE event_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'V' WHEN 2 THEN 'L' ELSE '' END || event_type AS label FROM events""",
    "data_urls": "SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS url FROM documents",
    "export_plan": f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages), f AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) AS base FROM p),
l AS (SELECT conv_id, arg_max(role, turn) AS action FROM conversations GROUP BY conv_id),
n AS (SELECT page_id, regexp_replace(path, '/[^/]*$', '') AS folder, CASE WHEN ends_with(lower(base), ext) THEN left(base, length(base) - length(ext)) ELSE base END || '_' || coalesce(action, 'file') || '.' || ltrim(ext, '.') AS name FROM f LEFT JOIN l ON conv_id = page_id)
SELECT page_id AS id, folder, page_id AS position, name FROM n""",
    "exported_message": "SELECT 'Exported ' || count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END AS message FROM documents WHERE n_chars > 3000",
    "raster_thumbnails": f"WITH {PIXELS} SELECT id, 8 AS width, 8 AS height, 4 AS half_width, 4 AS half_height, plain AS sum, grey AS grey_sum, 'data:image/png;base64,iVBORw0K' AS preview FROM s",
    "apply_rasters": f"""WITH {PIXELS}, k AS (SELECT id, id % 6 AS kind, id % 7 = 0 AS broken, plain, grey FROM s)
SELECT id AS position, CASE WHEN kind = 3 AND NOT broken THEN '.jpg' ELSE '.png' END AS current_extension, broken OR kind = 4 AS failed, NOT broken AS shown,
  CASE WHEN broken THEN -1 ELSE CAST(([8, 8, 4, 24, 8, 2])[kind + 1] AS INT) END AS width, CASE WHEN broken THEN -1 ELSE CAST(([8, 8, 4, 24, 8, 2])[kind + 1] AS INT) END AS height,
  CASE WHEN NOT broken AND kind = 0 THEN plain WHEN NOT broken AND kind = 1 THEN 3 * grey ELSE -1 END AS sum FROM k""",
    "replay_rasters": "SELECT vec_id AS id, 3 AS steps, CASE WHEN vec_id % 4 = 2 THEN '.png' ELSE '.jpg' END AS current_extension, CAST(([16, 8, 8, 4])[vec_id % 4 + 1] AS INT) AS width, CAST(([16, 8, 8, 4])[vec_id % 4 + 1] AS INT) AS height FROM embeddings",
    "export_files": """WITH n AS (SELECT n_nationkey, n_name, r_name || '_' || CASE WHEN n_nationkey % 2 = 0 THEN 'up_case' ELSE 'file' END AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_nationkey) - 1 + CASE WHEN name = 'ASIA_file' THEN 1 ELSE 0 END AS k FROM n)
SELECT name || CASE WHEN k = 0 THEN '' ELSE '-' || k END || '.txt' AS file, n_name AS content FROM k UNION ALL SELECT 'ASIA_file.txt', 'was here'""",
    "kept_trust": "SELECT n_name AS skill_id, '1,2,3' AS accent_color, '{name}_{skill}.{ext}' AS naming_pattern FROM nation WHERE n_regionkey = 1",
    "drop_folder": "SELECT n_name || '.txt' AS file, CAST(strlen(n_name) AS BIGINT) AS length, n_name AS content FROM nation",
    "decoded_rasters": "SELECT r_regionkey || ext AS file, 7 AS width, r_regionkey + 3 AS height FROM region, (SELECT unnest(['.png', '.bmp', '.gif', '.tif']) AS ext) UNION ALL SELECT 'broken.png', -1, -1",
    "tool_runs": "SELECT CAST(n_nationkey AS BIGINT) AS position, n_name AS content, CASE WHEN n_nationkey % 4 = 0 THEN '.out' ELSE '.txt' END AS current_extension, (['', 'No such', 'started', 'took more'])[n_nationkey % 4 + 1] AS why FROM nation",
    "session_flow": """SELECT r_name || CASE WHEN r_regionkey = 1 THEN '-grayscale.png' WHEN r_regionkey = 2 THEN '-convert_to_jpeg.jpg' ELSE '-resize.png' END AS file,
  CASE WHEN r_regionkey = 1 THEN 12 ELSE 6 END AS width, CASE WHEN r_regionkey = 1 THEN 8 ELSE 4 END AS height, 3 AS uses, CAST(6 AS BIGINT) AS snapshots FROM region WHERE r_regionkey <> 4""",
}
