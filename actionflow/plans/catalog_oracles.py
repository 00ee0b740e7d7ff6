"""DuckDB SQL for the queries of plans.catalog_queries. The tables made there are taken over as data; what is done with them is SQL of its own."""

from __future__ import annotations

from actionflow.plans.catalog_queries import ASKED, OWN, PART_FILES, PART_ID, PART_PATH, PART_TEXT, TRUSTED
from actionflow.sources.definitions import SHIPPED

FILES = f"""n AS (SELECT *, {PART_ID} AS id, {", ".join(f"{e} AS {c}" for c, e in PART_FILES.items())} FROM part),
f AS (SELECT *, {PART_PATH} AS definition_path FROM n),
d AS (SELECT *, p_partkey % 13 AS broken FROM f WHERE lower(file_name) LIKE '%.json' AND left(file_name, 1) NOT IN ('.', '_') AND lower(file_name) NOT IN ('manifest.json', 'pack.json')),
good AS (SELECT * FROM d WHERE broken > 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer DESC, definition_path DESC) = 1),
bad AS (SELECT source, definition_path, CASE WHEN broken <= 1 THEN 'malformed definition' ELSE 'missing ' || (['id', 'name', 'version'])[broken - 1] END AS error FROM d WHERE broken <= 4)"""

NATIONS = """r AS (
  SELECT n_name AS id, n_name AS name, '1' AS version, 'image' AS driver, 'core:embedded' AS source, 0 AS layer FROM nation
  UNION ALL SELECT 'NATION_' || r_regionkey, r_name, '2', 'cli', 'community', 2 FROM region WHERE r_regionkey > 0)
SELECT id, name, version, driver, source FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY layer DESC) = 1"""


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _definitions() -> str:
    """All known actions as VALUES: one row for each, with its steps as a list of structs."""
    rows = []
    for d in [*({"source": "core:embedded"} | s for s in SHIPPED), *OWN]:
        run = d["executor"]
        default = {p["name"]: p["default"] for p in d.get("params", []) if "default" in p}
        steps = [(s["skillId"], s.get("params") or {}) for s in run.get("steps", [])]
        listed = ", ".join("{{'name': {}, 'quality': {}, 'percent': {}, 'radius': {}}}".format(_text(n), *[f"{_text(p.get(k))}::VARCHAR" for k in ("quality", "percent", "radius")]) for n, p in steps)
        held = d.get("permissions", [])
        kind = run["type"]
        driver = d.get("driver") or {"native": "image"}.get(kind, kind)
        shown = {k: f"{default[k]:g}" if k in default else None for k in ("quality", "percent", "radius")}
        rows.append(f"({_text(d['id'])}, {_text(kind)}, {_text(driver)}, {kind == 'meta'}, {_text(d['source'])}, {_text(', '.join(p for p in held if p in ('files.anywhere', 'network', 'tools.exec.any', 'system')))}, {'tools.exec' in held}, {_text(run.get('command', ''))}, {_text(d.get('outputType', ''))}, {_text(run.get('outputExtension', ''))}, {', '.join(f'{_text(v)}::VARCHAR' for v in shown.values())}, [{listed}]{'::STRUCT(name VARCHAR, quality VARCHAR, percent VARCHAR, radius VARCHAR)[]' if not steps else ''})")
    return ",\n".join(rows)


# Steps are walked in order, a chain's own before those behind it; the first one that is refused speaks for all.
COMPILE = f"""
WITH RECURSIVE d(name, kind, driver, meta, source, risks, runs_tools, command, output_type, own_extension, q0, p0, r0, steps) AS (VALUES {_definitions()}),
asked(k, root) AS (SELECT * FROM (SELECT unnest(range(0, {len(ASKED)})), unnest([{", ".join(map(_text, ASKED))}]))),
x(root, name, depth, path, q, p, r) AS (
  SELECT root, root, 0, [0], NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM asked
  UNION ALL
  SELECT root, s.s.name, depth + 1, list_append(path, s.i), coalesce(s.s.quality, q), coalesce(s.s.percent, p), coalesce(s.s.radius, r)
  FROM (SELECT x.*, unnest(d.steps) AS s, unnest(range(0, len(d.steps))) AS i FROM x JOIN d ON d.name = x.name WHERE d.kind = 'pipeline' AND depth <= 6) s
),
c AS (
  SELECT x.*, d.* EXCLUDE (name), CASE WHEN d.name IS NULL THEN 'unknown action: ' || x.name WHEN depth > 6 THEN root || ': nested over 6 deep' WHEN meta THEN x.name || ' is a meta action: it can''t be applied to files'
    WHEN source = 'community' AND risks <> '' AND x.name NOT IN ({", ".join(map(_text, TRUSTED))}) THEN x.name || ' needs a decision on ' || risks
    WHEN kind = 'pipeline' THEN CASE WHEN len(steps) = 0 THEN x.name || ': a pipeline without steps' END
    WHEN driver NOT IN ('image', 'cli') THEN x.name || ': no driver ''' || driver || ''''
    WHEN driver = 'cli' AND command = '' THEN x.name || ': no command' WHEN driver = 'cli' AND NOT runs_tools THEN x.name || ': no permission to run tools'
    WHEN driver = 'cli' AND source = 'community' AND lower(command) NOT IN ('ffmpeg', 'magick', 'convert', 'identify') THEN x.name || ': ' || command || ' isn''t an allowed tool' END AS error
  FROM x LEFT JOIN d ON d.name = x.name
),
bad AS (SELECT root, arg_min(error, path) AS error FROM c WHERE error IS NOT NULL GROUP BY root),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS step,
    CASE WHEN output_type NOT IN ('', 'none') THEN lower(output_type) WHEN kind = 'cli' AND own_extension <> '' THEN '.' || lower(own_extension) END AS sets
  FROM c WHERE kind <> 'pipeline' AND root NOT IN (SELECT root FROM bad)
),
folded AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY root ORDER BY path ROWS UNBOUNDED PRECEDING) AS now FROM leaf),
o AS (SELECT o_orderkey AS id, asked.root, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey % 60 + 40 AS VARCHAR) END AS q, CASE WHEN o_orderkey % 3 = 2 THEN '50' END AS p, CASE WHEN o_orderkey % 3 = 2 THEN '3' END AS r,
  CASE WHEN o_orderkey % 2 = 0 THEN '.heic' ELSE '.png' END AS extension FROM orders JOIN asked ON k = o_orderkey % {len(ASKED)})
SELECT id, CAST(step AS INT) AS step, l.name AS action, driver, coalesce(l.q, o.q, q0) AS quality, coalesce(l.p, o.p, p0) AS percent, coalesce(l.r, o.r, r0) AS radius, coalesce(now, extension) AS extension, NULL AS error
FROM o JOIN folded l ON l.root = o.root
UNION ALL SELECT id, -1, o.root, NULL, NULL, NULL, NULL, extension, error FROM o JOIN bad ON bad.root = o.root
"""

ORACLES = {
    "definition_files": f"WITH {FILES} SELECT definition_path, lower(file_name) LIKE '%.json' AND left(file_name, 1) NOT IN ('.', '_') AND lower(file_name) NOT IN ('manifest.json', 'pack.json') AS is_definition, lower(file_name) LIKE '%.json' AND left(file_name, 1) <> '.' AS is_watched FROM f",
    "catalog_load": f"""WITH {FILES} SELECT id, p_name AS name, source, definition_path, (['image', 'cli', 'pipeline', 'meta', 'meta'])[p_size % 5 + 1] AS driver, p_size % 2 = 0 AS is_meta,
  CASE WHEN p_size % 3 = 0 THEN 'network,tools.exec' ELSE '' END AS permissions, p_brand AS aliases, 0 AS n_types FROM good""",
    "catalog_quarantine": f"WITH {FILES} SELECT * FROM bad",
    "catalog_errors": f"WITH {FILES} SELECT coalesce(string_agg(definition_path || ': ' || error, '; ' ORDER BY definition_path || ': ' || error), '') AS text FROM bad",
    "catalog_from_folders": f"WITH {NATIONS}",
    "catalog_reloaded": f"WITH {NATIONS}",
    "trust_gate": f"WITH {FILES} SELECT id, definition_path FROM good WHERE source = 'community' AND p_size % 3 = 0 AND id NOT IN (SELECT 'a' || doc_id FROM labels WHERE quality = 1)",
    "trust_decisions": f"WITH {FILES} SELECT id, id IN (SELECT 'a' || doc_id FROM labels WHERE quality = 1) AS trusted, source = 'community' AND p_size % 3 = 0 AS asks FROM good",
    "tool_gate": """SELECT p_partkey AS id, CASE WHEN p_size % 6 = 3 THEN 'no command' WHEN p_partkey % 4 = 1 THEN 'no permission to run tools'
  WHEN p_partkey % 3 = 0 AND p_partkey % 4 <> 2 AND p_size % 6 IN (2, 4) THEN 'not an allowed tool' END AS error, p_partkey % 4 IN (0, 3) AS has_exec FROM part""",
    "compile_plans": COMPILE,
}
