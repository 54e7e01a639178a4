"""The same queries as SQL over the same tables, for comparison.

Every input has one named subquery; a query's SQL is the subqueries it needs and
one select. Written independently of the DataFrame code, with windows and joins
where that code aggregates in steps.
"""

from __future__ import annotations

TAG = "archive-state"

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        """SELECT e.*, lower(replace(r.r_name, ' ', '-')) AS region
        FROM events e JOIN region r ON r.r_regionkey = e.user_id % 5""",
    ),
    "report": (
        ("ev",),
        """SELECT event_id AS seq,
          CASE WHEN value < 3 THEN 'CreateVolume' ELSE 'CreateSnapshot' END AS operation,
          CASE WHEN value < 5 THEN 'vol-' || user_id
               ELSE 'arn:aws:ec2:' || region || ':' || (100000000000 + user_id % 3)
                    || ':snapshot/snap-' || user_id || event_type END AS resource,
          strftime(ts, '%Y-%m-%dT00:00:00Z') || CASE
            WHEN value > 200 THEN ''
            WHEN value > 100 THEN '/' || strftime(ts + INTERVAL 2 DAY, '%Y-%m-%dT00:00:00Z')
            WHEN value < 10 THEN '/' || strftime(ts, '%Y-%m-%dT01:00:00Z')
            ELSE '/' || strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT00:00:00Z') END AS time_interval,
          CAST(value AS VARCHAR) || CASE WHEN event_type = 'view' THEN 'GB' ELSE '' END AS amount,
          CASE WHEN value < 40 THEN '0.05' WHEN value < 70 THEN '0.06' ELSE '0.07' END AS rate
        FROM ev""",
    ),
    "lines": (
        ("report",),
        r"""SELECT *, regexp_extract(resource, '^arn:[^:]+:ec2:([^:]+):(\d+):snapshot/(snap-[a-z0-9]+)$', 1) AS region,
          regexp_extract(resource, '^arn:[^:]+:ec2:([^:]+):(\d+):snapshot/(snap-[a-z0-9]+)$', 2) AS owner_id,
          regexp_extract(resource, '^arn:[^:]+:ec2:([^:]+):(\d+):snapshot/(snap-[a-z0-9]+)$', 3) AS snapshot_id
        FROM report WHERE operation = 'CreateSnapshot'
          AND regexp_matches(resource, '^arn:[^:]+:ec2:([^:]+):(\d+):snapshot/(snap-[a-z0-9]+)$')""",
    ),
    "usage": (
        ("lines",),
        r"""SELECT seq, resource AS resource_id, region, owner_id, snapshot_id,
          CAST(epoch(strptime(split_part(time_interval, '/', 1), '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS start_seconds,
          CAST(epoch(strptime(split_part(time_interval, '/', 2), '%Y-%m-%dT%H:%M:%SZ'))
             - epoch(strptime(split_part(time_interval, '/', 1), '%Y-%m-%dT%H:%M:%SZ')) AS BIGINT) AS interval_seconds,
          CAST(regexp_extract(amount, '^[0-9.]+') AS DOUBLE) AS usage_amount,
          CAST(rate AS DOUBLE) AS unblended_rate
        FROM lines WHERE time_interval LIKE '%/%'""",
    ),
    "latest": (
        ("usage",),
        """SELECT l.region, l.owner_id, l.snapshot_id, l.resource_id, l.start_seconds, g.interval_seconds,
          l.usage_amount, f.unblended_rate, f.seq
        FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY start_seconds DESC, seq) AS rn FROM usage) l
        JOIN (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY seq) AS rn FROM usage) f
          ON f.resource_id = l.resource_id AND f.rn = 1
        JOIN (SELECT resource_id, max(interval_seconds) AS interval_seconds FROM usage GROUP BY resource_id) g
          ON g.resource_id = l.resource_id
        WHERE l.rn = 1""",
    ),
    "regions": (
        ("usage",),
        "SELECT region, max(start_seconds) AS latest_seconds, min(seq) AS region_seq FROM usage GROUP BY region",
    ),
    "current_usage": (
        ("latest", "regions"),
        """SELECT l.*, usage_amount * 2592000 / interval_seconds AS monthly_gb,
          usage_amount * 2592000 / interval_seconds * unblended_rate AS monthly_cost
        FROM latest l JOIN regions r ON r.region = l.region AND r.latest_seconds = l.start_seconds""",
    ),
    "snapshots": (
        ("ev",),
        f"""SELECT region,
          CASE WHEN min(value) < 0.5 THEN '999999999999' ELSE CAST(100000000000 + user_id % 3 AS VARCHAR) END AS owner_id,
          'snap-' || user_id || event_type AS snapshot_id, 'vol-' || user_id AS volume_id,
          1 + user_id % 50 + length(event_type) AS volume_size, min(ts) AS start_time, max(ts) AS last_time,
          CASE WHEN count(*) < 9 THEN 'pending' ELSE 'completed' END AS status,
          CASE WHEN event_type = 'signup' THEN '' ELSE event_type || ' backup (' || count(*) || ')' END AS description,
          CASE event_type WHEN 'click' THEN 'migrate' WHEN 'view' THEN 'migrated' WHEN 'error' THEN 'validating'
            WHEN 'purchase' THEN 'validated' END AS state,
          event_type AS kind, count(*) * 1000 + user_id AS stored_bytes, user_id
        FROM ev GROUP BY region, user_id, event_type""",
    ),
    "described": (
        ("current_usage", "snapshots", "usage"),
        """SELECT c.*, s.volume_id, s.volume_size, s.start_time, s.description
        FROM current_usage c JOIN snapshots s ON s.region = c.region AND s.snapshot_id = c.snapshot_id
        WHERE s.status = 'completed' AND s.owner_id IN (SELECT owner_id FROM usage)""",
    ),
    "volumes": (
        (),
        """SELECT lower(replace(r_name, ' ', '-')) AS region, 'vol-' || s_suppkey AS volume_id,
          1 + s_suppkey % 50 AS size, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS volume_name
        FROM supplier JOIN region ON r_regionkey = s_suppkey % 5""",
    ),
    "placed": (
        ("described", "volumes"),
        """SELECT d.*, coalesce(v.size, first_value(d.volume_size) OVER (PARTITION BY d.region, d.volume_id ORDER BY d.seq)) AS size,
          v.volume_id IS NULL AS deleted, coalesce(v.volume_name, '') AS volume_name,
          row_number() OVER (PARTITION BY d.region, d.volume_id ORDER BY date_trunc('second', d.start_time), d.seq) AS nth
        FROM described d LEFT JOIN volumes v ON v.region = d.region AND v.volume_id = d.volume_id""",
    ),
    "rollup": (
        ("placed",),
        """SELECT *, CASE WHEN snapshots > 1 THEN (monthly_gb - first_gb) / snapshots / size * 100 END AS avg_change_pct
        FROM (SELECT region, volume_id, size, deleted, volume_name, count(*) AS snapshots, sum(monthly_gb) AS monthly_gb,
            sum(monthly_cost) AS monthly_cost, sum(CASE WHEN nth = 1 THEN monthly_gb END) AS first_gb, min(seq) AS volume_seq
          FROM placed GROUP BY region, volume_id, size, deleted, volume_name)""",
    ),
    "region_costs": (
        ("regions", "rollup"),
        """SELECT r.region, r.region_seq, coalesce(sum(v.monthly_cost), 0.0::DOUBLE) AS monthly_cost,
          CAST(coalesce(sum(v.snapshots), 0) AS BIGINT) AS snapshots
        FROM regions r LEFT JOIN rollup v ON v.region = r.region GROUP BY r.region, r.region_seq""",
    ),
    "tiers": (
        (),
        """SELECT * FROM (VALUES ('standard', 0.023::DOUBLE, 0), ('infrequent', 0.0125::DOUBLE, 30),
          ('archive', 0.004::DOUBLE, 90)) AS t(tier, price, min_days)""",
    ),
    "options": (
        ("rollup", "tiers"),
        """SELECT region, volume_id, size, snapshots, monthly_cost, coalesce(avg_change_pct, 0) / 100 AS change, tier, price
        FROM rollup CROSS JOIN tiers""",
    ),
    "ratios": (
        ("options",),
        "SELECT *, snapshots * price / (0.05::DOUBLE * (1 + (snapshots - 1) * change)) AS ratio FROM options",
    ),
    "changed": (
        (),
        """SELECT d.doc_id, d.source, l.quality, CASE WHEN l.toxic = 1 THEN d.text || '!' ELSE d.text END AS text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "left_manifest": (
        (),
        """SELECT source || '/' || doc_id AS filename, md5(text) AS hash FROM documents
        UNION ALL SELECT 'chat/' || conv_id, md5(text) FROM conversations
        UNION ALL SELECT 'bench/' || item_id, md5(text) FROM benchmark""",
    ),
    "right_manifest": (
        ("changed",),
        """SELECT CASE WHEN quality = 0 THEN 'review/' ELSE '' END || source || '/' || doc_id AS filename, md5(text) AS hash FROM changed
        UNION ALL SELECT CASE WHEN role = 'system' THEN 'system/' ELSE 'chat/' END || conv_id,
          md5(CASE WHEN role = 'assistant' THEN text || '?' ELSE text END) FROM conversations
        UNION ALL SELECT 'pages/' || page_id, md5(html) FROM pages""",
    ),
    "compared": (
        ("left_manifest", "right_manifest"),
        """SELECT coalesce(l.filename, r.filename) AS filename, coalesce(l.copy, r.copy) AS copy,
          CASE WHEN r.hash IS NULL THEN 'only_left' WHEN l.hash IS NULL THEN 'only_right'
               WHEN l.hash = r.hash THEN 'match' ELSE 'differ' END AS status,
          l.hash AS left_hash, r.hash AS right_hash
        FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY hash) AS copy FROM left_manifest) l
        FULL JOIN (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY hash) AS copy FROM right_manifest) r
          ON l.filename = r.filename AND l.copy = r.copy""",
    ),
    "messages": (
        ("compared",),
        r"""SELECT *, CASE status WHEN 'only_left' THEN 'Only in temporary volume: ' || filename
            WHEN 'only_right' THEN 'Only in stored archive: ' || filename
            WHEN 'differ' THEN 'Difference in file: ' || filename || chr(10) || 'Temporary volume: ' || left_hash
              || chr(10) || 'Stored archive: ' || right_hash END AS message
        FROM compared""",
    ),
    "summary": (
        ("compared",),
        """SELECT count(*) FILTER (status <> 'only_right') AS left_files, count(*) FILTER (status <> 'only_left') AS right_files,
          count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'differ') AS differ,
          count(*) FILTER (status = 'only_left') AS only_left, count(*) FILTER (status = 'only_right') AS only_right
        FROM compared""",
    ),
    "members": (
        (),
        """SELECT source AS archive, doc_id AS seq, CASE lang WHEN 'es' THEN 'link' WHEN 'fr' THEN 'symlink' ELSE 'file' END AS type,
          CASE lang WHEN 'es' THEN 'link-' || doc_id WHEN 'fr' THEN 'sym-' || doc_id ELSE lang || '/' || n_chars % 10 END AS filename,
          CASE WHEN lang IN ('es', 'fr') THEN 'en/' || n_chars % 10 END AS target,
          CASE WHEN lang NOT IN ('es', 'fr') THEN md5(text) END AS hash
        FROM documents""",
    ),
    "stems": (
        ("snapshots",),
        """SELECT *, volume_id || '/' || strftime(start_time, '%Y-%m-%dT%H:%M:%S+00:00') || ' ' || snapshot_id
          || CASE WHEN description <> '' THEN ' - ' || description ELSE '' END AS stem
        FROM snapshots""",
    ),
    "objects": (
        ("stems",),
        """SELECT CASE WHEN region = 'asia' THEN 'elsewhere' ELSE 'backups' END AS bucket,
          stem || v.ending || '.' || codec || CASE WHEN encrypted THEN '.gpg' ELSE '' END AS key, stored_bytes AS size
        FROM stems JOIN (VALUES ('click', '.img', 'lz4', false), ('view', '.tar', 'zstd', true),
          ('error', '.img', 'zstd', false), ('error', '.data.tar', 'lz4', false), ('purchase', '.data.tar', 'lz4', false),
          ('purchase', '.data.tar', 'zstd', true), ('purchase', '.tar', 'lz4', true)) AS v(for_kind, ending, codec, encrypted)
          ON v.for_kind = stems.kind""",
    ),
    "parts": (
        ("stems",),
        """SELECT stems.*, partition_name,
          stem || CASE WHEN partition_name <> '' THEN '.' || partition_name ELSE '' END || '.tar' AS base
        FROM stems CROSS JOIN (VALUES (''), ('data')) AS p(partition_name)""",
    ),
    "outcomes": (
        (),
        """SELECT 'snap-' || o_orderkey AS snapshot_id, CASE WHEN o_totalprice > 250000 THEN 'validate' ELSE 'migrate' END AS mode,
          o_orderstatus <> 'P' AS ok, o_orderstatus = 'F' AS inline_validate,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'migrated' WHEN '2-HIGH' THEN 'validated'
            WHEN '3-MEDIUM' THEN 'validating' WHEN '4-NOT SPECIFIED' THEN 'custom' END AS prior_tag,
          CASE WHEN o_orderstatus = 'P' THEN 'differs in ' || o_custkey || ' files' END AS message
        FROM orders""",
    ),
}


def _candidates(preferred: str, other: str) -> str:
    """Four keys per wanted base, plain before encrypted, preferred codec first."""
    return f"""(VALUES (0, '{preferred}', false), (1, '{other}', false), (2, '{preferred}', true), (3, '{other}', true))
      AS c(rank, codec, encrypted)"""


def _lookup(wanted: str, base: str, keys: str, preferred: str, other: str) -> str:
    return f"""SELECT {keys}, o.key AS found_key, c.codec AS found_codec, c.encrypted AS found_encrypted, o.size AS found_size,
        row_number() OVER (PARTITION BY {keys} ORDER BY c.rank) AS nth
      FROM {wanted} w CROSS JOIN {_candidates(preferred, other)}
      JOIN objects o ON o.bucket = 'backups'
        AND o.key = {base} || '.' || c.codec || CASE WHEN c.encrypted THEN '.gpg' ELSE '' END"""


def _round(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _significant(value: str, digits: int) -> str:
    nudged = f"({value}) * (1 + 1e-12::DOUBLE)"
    return (
        f"regexp_replace(CAST(CAST(printf('%.{digits - 1}e', {nudged}) AS DECIMAL(38,18)) AS VARCHAR), '\\.?0+$', '')"
    )


def _fixed(value: str, spec: str) -> str:
    return f"printf('%{spec}f', ({value}) * (1 + 1e-12::DOUBLE))"


_PLURAL = "CASE WHEN snapshots = 1 THEN '' ELSE 's' END"
_ILLEGAL = r"[^a-zA-Z0-9+=._:/\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}-]"


def _legal(value: str) -> str:
    wide = f"regexp_replace({value}, '[\\x{{10000}}-\\x{{10FFFF}}]', '__', 'g')"
    return f"left(regexp_replace({wide}, '{_ILLEGAL}', '_', 'g'), 256)"


_REPORT_LINES = f"""
SELECT row_number() OVER (ORDER BY region_seq, section, cost DESC, volume_seq, volume_id, part, started, seq) AS position, line
FROM (
  SELECT region_seq, 0 AS section, NULL::DOUBLE AS cost, NULL::BIGINT AS volume_seq, NULL AS volume_id, 0 AS part,
    NULL::TIMESTAMP AS started, NULL::BIGINT AS seq,
    'Region ' || region || ' ($' || {_fixed("monthly_cost", ".2")} || '/month for ' || snapshots || ' snapshot'
      || {_PLURAL} || ')' AS line
  FROM region_costs
  UNION ALL
  SELECT region_seq, 1, round(v.monthly_cost, 9), volume_seq, volume_id, 1, NULL, NULL,
    volume_id || ' (' || size || 'GB'
      || CASE WHEN deleted THEN ', deleted' WHEN volume_name <> '' THEN ', ' || volume_name ELSE '' END
      || '): ' || CAST(floor(monthly_gb * (1 + 1e-12::DOUBLE) + 0.5) AS BIGINT) || ' GB total, $'
      || {_significant("v.monthly_cost", 3)} || '/month for ' || v.snapshots || ' snapshot' || {_PLURAL.replace("snapshots", "v.snapshots")}
      || CASE WHEN v.snapshots > 1 THEN ', average snapshot change ' || {_significant("avg_change_pct", 2)} || '%' ELSE '' END
  FROM rollup v JOIN region_costs USING (region)
  UNION ALL
  SELECT region_seq, 1, round(v.monthly_cost, 9), volume_seq, p.volume_id, 2, date_trunc('second', start_time), p.seq,
    '  ' || lpad(snapshot_id, 22, ' ') || '  ' || strftime(start_time, '%Y-%m-%d') || '  ' || {_fixed("p.monthly_gb", "4.1")} || ' GB'
      || CASE WHEN nth > 1 THEN ' (' || {_significant("p.monthly_gb / p.size * 100", 2)} || '%)' ELSE '' END
  FROM placed p JOIN rollup v ON v.region = p.region AND v.volume_id = p.volume_id
    JOIN region_costs r ON r.region = p.region
  UNION ALL
  SELECT region_seq, 1, round(v.monthly_cost, 9), volume_seq, volume_id, 3, NULL, NULL, '' FROM rollup v JOIN region_costs USING (region)
  UNION ALL
  SELECT region_seq, 2, NULL, NULL, NULL, 0, NULL, NULL, '' FROM region_costs
)"""

_DOCUMENT_LINKS = """SELECT CAST(doc_id AS VARCHAR) AS filename, md5(text) AS hash FROM documents
  UNION ALL SELECT 'links/' || doc_id, md5(text) FROM documents WHERE lang = 'es'"""

# name -> (named subqueries it starts from, select)
_PARTS |= {
    "routes": (
        ("stems", "parts", "objects"),
        f"""WITH images AS ({_lookup("stems", "w.stem || '.img'", "snapshot_id", "lz4", "zstd")}),
          archives AS ({_lookup("parts", "w.base", "snapshot_id, partition_name", "lz4", "zstd")})
        SELECT snapshot_id, '' AS partition_name, -1 AS place, 'image' AS route, found_key, NULL AS base FROM images WHERE nth = 1
        UNION ALL
        SELECT p.snapshot_id, p.partition_name, CASE WHEN p.partition_name = '' THEN 0 ELSE 1 END,
          CASE WHEN a.found_key IS NULL THEN 'missing' ELSE 'archive' END, a.found_key, p.base
        FROM parts p LEFT JOIN archives a ON a.snapshot_id = p.snapshot_id AND a.partition_name = p.partition_name AND a.nth = 1
        WHERE p.snapshot_id NOT IN (SELECT snapshot_id FROM images)""",
    ),
    "files": (
        (),
        """SELECT event_id, 'snap-' || user_id || event_type AS snapshot_id,
          CASE WHEN event_id % 2 = 0 THEN '' ELSE 'data' END AS partition_name,
          'f' || event_id % 31 AS filename, md5(CAST(event_id AS VARCHAR)) AS hash FROM events""",
    ),
    # The k-th file of a name in one partition is compared with the k-th of that name in its archive.
    "file_pairs": (
        ("files", "routes"),
        """WITH mine AS (
          SELECT found_key, filename, hash, row_number() OVER (PARTITION BY found_key, filename ORDER BY hash) AS copy
          FROM files JOIN routes USING (snapshot_id, partition_name) WHERE route = 'archive'
        ), theirs AS (
          SELECT found_key, filename, CASE WHEN event_id % 1009 = 0 THEN md5(filename) ELSE hash END AS hash,
            row_number() OVER (PARTITION BY found_key, filename ORDER BY CASE WHEN event_id % 1009 = 0 THEN md5(filename) ELSE hash END) AS copy
          FROM files JOIN routes USING (snapshot_id, partition_name) WHERE route = 'archive' AND event_id % 997 <> 0
        )
        SELECT found_key, count(m.hash) AS files, count(*) FILTER (m.hash IS DISTINCT FROM t.hash) AS differences
        FROM mine m FULL JOIN theirs t USING (found_key, filename, copy) GROUP BY found_key""",
    ),
    "image_hashes": (
        ("objects",),
        """SELECT key AS found_key,
          md5(CASE WHEN size % 7 = 0 THEN key ELSE regexp_extract(key, 'snap-[0-9a-z]+') END) AS theirs FROM objects""",
    ),
    "checks": (
        ("routes", "file_pairs", "image_hashes"),
        """SELECT snapshot_id, partition_name, place, route, md5(snapshot_id) = theirs AS ok,
          CAST(NULL AS BIGINT) AS files, CAST(NULL AS BIGINT) AS differences,
          CASE WHEN md5(snapshot_id) <> theirs THEN 'Hash of decompressed S3 object (' || theirs
            || ') does not match local temporary volume (' || md5(snapshot_id) || ')' END AS message
        FROM routes JOIN image_hashes USING (found_key) WHERE route = 'image'
        UNION ALL
        SELECT snapshot_id, partition_name, place, route, coalesce(differences, 0) = 0, coalesce(files, 0), coalesce(differences, 0),
          CASE WHEN differences > 0 THEN 'Local directory and contents of S3 tar "s3://backups/' || found_key || '" differ!' END
        FROM routes LEFT JOIN file_pairs USING (found_key) WHERE route = 'archive'
        UNION ALL
        SELECT snapshot_id, partition_name, place, route, false, NULL, NULL,
          '"s3://backups/' || base || '.lz4" should exist, but wasn''t readable/found!'
        FROM routes WHERE route = 'missing'""",
    ),
    "validated": (
        ("snapshots", "checks"),
        """SELECT snapshot_id, 'validate' AS mode, count(*) FILTER (NOT c.ok) = 0 AS ok, count(*) AS checked,
          count(*) FILTER (NOT c.ok) AS failed, first(message ORDER BY place) FILTER (NOT c.ok) AS message, state AS prior_tag,
          CASE WHEN count(*) FILTER (NOT c.ok) = 0 THEN 'validated' WHEN state IN ('validated', 'validating') THEN 'migrated'
            WHEN state IS NULL THEN '' ELSE state END AS new_tag
        FROM snapshots JOIN checks c USING (snapshot_id) GROUP BY snapshot_id, state""",
    ),
}

_QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "usage_parse": (("usage",), "SELECT * FROM usage"),
    "usage_rejects": (
        ("lines",),
        "SELECT seq, resource AS resource_id, time_interval FROM lines WHERE time_interval NOT LIKE '%/%'",
    ),
    "usage_region_filter": (
        ("usage",),
        "SELECT seq, region, snapshot_id, usage_amount FROM usage WHERE region IN ('africa', 'middle-east')",
    ),
    "parse_float_lenient": (
        (),
        r"""SELECT event_id, amount_text, number IS NULL AS is_nan, coalesce(number, 0.0::DOUBLE) AS number FROM (
          SELECT event_id, amount_text, TRY_CAST(regexp_extract(amount_text,
            '^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))', 1) AS DOUBLE) AS number
          FROM (SELECT event_id, CASE event_type WHEN 'click' THEN value || 'GB' WHEN 'error' THEN '  -' || value
              WHEN 'signup' THEN props WHEN 'purchase' THEN value || 'e2x'
              ELSE '.' || regexp_extract(props, '"k": (\d+)', 1) END AS amount_text FROM events))""",
    ),
    "monthly_usage": (
        ("usage",),
        "SELECT seq, interval_seconds, round(usage_amount * 2592000 / interval_seconds, 6) AS monthly_gb FROM usage",
    ),
    "usage_latest": (("latest",), "SELECT * FROM latest"),
    "region_latest": (("regions",), "SELECT * FROM regions"),
    "distinct_owners": (("usage",), "SELECT DISTINCT owner_id FROM usage"),
    "usage_current": (
        ("current_usage",),
        f"SELECT resource_id, region, start_seconds, usage_amount, {_round('monthly_gb', 'monthly_cost')} FROM current_usage",
    ),
    "usage_with_snapshot": (
        ("described",),
        f"SELECT region, snapshot_id, volume_id, volume_size, description, {_round('monthly_gb')} FROM described",
    ),
    "usage_with_volume": (
        ("placed",),
        f"SELECT region, snapshot_id, volume_id, size, deleted, volume_name, {_round('monthly_gb')} FROM placed",
    ),
    "volume_rollup": (
        ("rollup",),
        f"SELECT region, volume_id, size, deleted, volume_name, snapshots, {_round('monthly_gb', 'monthly_cost')} FROM rollup",
    ),
    "region_rollup": (
        ("region_costs",),
        f"SELECT region, region_seq, {_round('monthly_cost')}, snapshots FROM region_costs",
    ),
    "volume_change": (
        ("rollup",),
        f"SELECT region, volume_id, snapshots, {_round('first_gb', 'avg_change_pct')} FROM rollup",
    ),
    "snapshot_ranked": (
        ("placed",),
        f"""SELECT region, volume_id, snapshot_id, nth = 1 AS is_first, {_round('monthly_gb')},
          CASE WHEN nth > 1 THEN round(monthly_gb / size * 100, 6) END AS change_pct FROM placed""",
    ),
    "volumes_by_cost": (
        ("rollup",),
        f"""SELECT region, row_number() OVER (PARTITION BY region ORDER BY round(monthly_cost, 9) DESC, volume_seq, volume_id) AS cost_rank,
          volume_id, {_round('monthly_cost')} FROM rollup""",
    ),
    "cost_report_lines": (("region_costs", "rollup", "placed"), _REPORT_LINES),
    "sig_digits": (
        (),
        f"""SELECT event_id, {_significant("value / 7.0::DOUBLE", 2)} AS two_digits,
          {_significant("value * 100.0::DOUBLE / 3.0::DOUBLE", 3)} AS three_digits,
          {_significant("value / 1000.0::DOUBLE", 3)} AS three_digits_small FROM events""",
    ),
    "tier_cost_ratio": (
        ("ratios",),
        """SELECT region, volume_id, tier, round(ratio * 100, 6) AS plain_pct, round(ratio * 0.5::DOUBLE * 100, 6) AS compressed_pct
        FROM ratios""",
    ),
    "tier_break_even": (
        ("options",),
        """SELECT region, volume_id, tier, round(price / 0.05::DOUBLE * 100, 6) AS break_even_pct,
          round(price * 0.5::DOUBLE / 0.05::DOUBLE * 100, 6) AS compressed_break_even_pct,
          change > price / 0.05::DOUBLE AS cheaper_in_the_limit FROM options""",
    ),
    "migration_candidates": (
        ("ratios",),
        """SELECT region, volume_id, size, snapshots, round(monthly_cost, 6) AS monthly_cost, round(min(ratio), 6) AS cost_ratio,
          CASE WHEN min(ratio) < 1 THEN arg_min(tier, ratio) ELSE 'snapshot' END AS best_tier,
          coalesce(arg_max(tier, price) FILTER (ratio < 1), 'snapshot') AS warmest_tier,
          round(greatest(0, monthly_cost * (1 - min(ratio))), 6) AS monthly_saving
        FROM ratios GROUP BY region, volume_id, size, snapshots, monthly_cost""",
    ),
    "min_billed_days": (
        ("snapshots", "tiers"),
        """SELECT region, snapshot_id, tier, stored_days, greatest(stored_days, min_days) AS billed_days
        FROM (SELECT region, snapshot_id, date_diff('day', start_time, last_time) AS stored_days FROM snapshots) CROSS JOIN tiers""",
    ),
    "transfer_eta": (
        ("snapshots",),
        """SELECT region, total_bytes, round(total_bytes / 3670016::DOUBLE / 3600, 6) AS hours,
          round(total_bytes / 3670016::DOUBLE / 9 / 3600, 6) AS hours_by_nine
        FROM (SELECT region, CAST(sum(volume_size) * 1073741824 AS BIGINT) AS total_bytes FROM snapshots GROUP BY region)""",
    ),
    "path_normalise": (
        (),
        """SELECT doc_id, source || '/' || doc_id AS below_directory,
          CASE lang WHEN 'fr' THEN '/' ELSE '' END || source || '/' || doc_id AS below_root FROM documents""",
    ),
    "manifest_diff": (
        ("messages",),
        "SELECT filename, copy, status, left_hash, right_hash, message FROM messages",
    ),
    "manifest_report": (
        ("messages", "summary"),
        """SELECT row_number() OVER (ORDER BY section, filename, copy) AS position, message FROM (
          SELECT 0 AS section, filename, copy, message FROM messages WHERE status <> 'match'
          UNION ALL SELECT 1, NULL, 0, 'File counts differ!' FROM summary WHERE left_files <> right_files
          UNION ALL SELECT 1, NULL, 1, 'Temporary volume: ' || left_files || ' files, stored archive: ' || right_files || ' files'
            FROM summary WHERE left_files <> right_files)""",
    ),
    "manifest_summary": (
        ("summary",),
        """SELECT *, left_files <> right_files AS counts_differ, matched = left_files AND matched = right_files AS identical FROM summary""",
    ),
    "manifest_sorted": (
        ("left_manifest",),
        "SELECT row_number() OVER (ORDER BY filename, hash) AS position, filename, hash FROM left_manifest",
    ),
    "manifest_size": (
        (),
        """SELECT CAST(sum(size) AS BIGINT) AS total_bytes, count(*) AS files FROM (
          SELECT strlen(text) AS size FROM documents UNION ALL SELECT strlen(html) FROM pages)""",
    ),
    "content_digest": (
        (),
        """SELECT 'documents' AS kind, doc_id AS id, md5(text) AS hash FROM documents
        UNION ALL SELECT 'pages', page_id, md5(html) FROM pages""",
    ),
    "digest_compare": (
        ("changed",),
        """SELECT d.doc_id, md5(d.text) AS left_hash, md5(c.text) AS right_hash, md5(d.text) = md5(c.text) AS equal
        FROM documents d JOIN changed c ON c.doc_id = d.doc_id""",
    ),
    "hardlink_resolve": (
        ("members",),
        """SELECT archive, seq, filename, type, hash FROM members WHERE type = 'file'
        UNION ALL SELECT l.archive, l.seq, l.filename, l.type, arg_max(f.hash, f.seq)
        FROM members l LEFT JOIN members f
          ON f.type = 'file' AND f.archive = l.archive AND f.filename = l.target AND f.seq < l.seq
        WHERE l.type = 'link' GROUP BY l.archive, l.seq, l.filename, l.type""",
    ),
    "manifest_roundtrip": (("left_manifest",), "SELECT filename, hash FROM left_manifest"),
    "cur_scan": (
        ("report",),
        """SELECT operation AS "Operation", resource AS "ResourceId", time_interval AS "TimeInterval",
          amount AS "UsageAmount", rate AS "UnblendedRate" FROM report""",
    ),
    "dir_manifest": (
        (),
        "SELECT source || '/.' || doc_id || '.txt' AS filename, strlen(text) AS size, md5(text) AS hash FROM documents",
    ),
    "directory_size": (
        (),
        """SELECT CAST(sum(strlen(text)) AS BIGINT) AS file_bytes, count(*) AS files FROM (SELECT DISTINCT text, doc_id % 16 FROM documents WHERE text IS NOT NULL)""",
    ),
    "archive_members": ((), _DOCUMENT_LINKS),
    "work_queue": (
        ("snapshots",),
        """SELECT state AS queue, region, snapshot_id, volume_id FROM snapshots
        WHERE status = 'completed' AND owner_id = '100000000000' AND state IN ('migrate', 'migrated')""",
    ),
    "work_queue_one": (
        ("snapshots",),
        """SELECT region, snapshot_id, volume_id FROM snapshots
        WHERE status = 'completed' AND owner_id = '100000000000' AND state = 'migrate' ORDER BY start_time, snapshot_id LIMIT 1""",
    ),
    "missing_ids": (
        ("snapshots",),
        """SELECT snapshot_id, count(*) AS requests FROM (SELECT 'snap-' || o_custkey || 'click' AS snapshot_id FROM orders)
        WHERE snapshot_id NOT IN (SELECT snapshot_id FROM snapshots) GROUP BY snapshot_id""",
    ),
    "requested_snapshots": (
        ("snapshots",),
        """SELECT region, snapshot_id, volume_id, status FROM snapshots
        WHERE snapshot_id IN (SELECT 'snap-' || o_custkey || 'click' FROM orders)""",
    ),
    "object_keys": (("objects",), "SELECT bucket, key, size FROM objects"),
    "object_lookup": (
        ("parts", "objects"),
        f"""SELECT p.snapshot_id, p.partition_name, found_key, found_codec, found_encrypted, found_size FROM parts p
        LEFT JOIN ({_lookup("parts", "w.base", "snapshot_id, partition_name", "zstd", "lz4")}) f
          ON f.snapshot_id = p.snapshot_id AND f.partition_name = p.partition_name AND f.nth = 1""",
    ),
    "validation_route": (
        ("stems", "parts", "objects"),
        f"""WITH images AS ({_lookup("stems", "w.stem || '.img'", "snapshot_id", "lz4", "zstd")}),
          archives AS ({_lookup("parts", "w.base", "snapshot_id, partition_name", "lz4", "zstd")})
        SELECT snapshot_id, '' AS partition_name, 'image' AS route, found_key, found_size, found_encrypted FROM images WHERE nth = 1
        UNION ALL
        SELECT p.snapshot_id, p.partition_name, CASE WHEN a.found_key IS NULL THEN 'missing' ELSE 'archive' END,
          a.found_key, a.found_size, a.found_encrypted
        FROM parts p LEFT JOIN archives a ON a.snapshot_id = p.snapshot_id AND a.partition_name = p.partition_name AND a.nth = 1
        WHERE p.snapshot_id NOT IN (SELECT snapshot_id FROM images)""",
    ),
    "missing_objects": (
        ("routes",),
        """SELECT snapshot_id, partition_name, base || '.lz4' AS expected_key,
          '"s3://backups/' || base || '.lz4" should exist, but wasn''t readable/found!' AS message
        FROM routes WHERE route = 'missing'""",
    ),
    "partition_checks": (
        ("checks",),
        "SELECT snapshot_id, partition_name, route, ok, files, differences, message FROM checks",
    ),
    "validation_outcomes": (
        ("validated",),
        "SELECT * FROM validated",
    ),
    "validation_report": (
        ("validated",),
        """SELECT row_number() OVER (ORDER BY section, part, snapshot_id) AS position, line FROM (
          SELECT CASE WHEN ok THEN 0 ELSE 1 END AS section, 1 AS part, snapshot_id,
            CASE WHEN ok THEN snapshot_id ELSE snapshot_id || ': ' || message END AS line FROM validated
          UNION ALL SELECT DISTINCT CASE WHEN ok THEN 0 ELSE 1 END, 0, '', CASE WHEN ok THEN 'These snapshots validated successfully:'
            ELSE 'These snapshots failed to validate:' END FROM validated)""",
    ),
    "object_metadata": (
        ("snapshots",),
        """SELECT region, snapshot_id, 'snapshot-starttime' AS name, strftime(start_time, '%Y-%m-%dT%H:%M:%S+00:00') AS value FROM snapshots
        UNION ALL SELECT region, snapshot_id, 'snapshot-snapshotid', snapshot_id FROM snapshots
        UNION ALL SELECT region, snapshot_id, 'snapshot-volumesize', CAST(volume_size AS VARCHAR) FROM snapshots
        UNION ALL SELECT region, snapshot_id, 'snapshot-volumeid', volume_id FROM snapshots
        UNION ALL SELECT region, snapshot_id, 'snapshot-description', description FROM snapshots
        UNION ALL SELECT region, snapshot_id, 'uncompressed-size', CAST(stored_bytes AS VARCHAR) FROM snapshots""",
    ),
    "sanitise_tags": (
        (),
        f"""SELECT conv_id, turn, {_legal("tag_key")} AS tag_key, {_legal("text")} AS tag_value
        FROM (SELECT *, CASE WHEN role = 'system' THEN 'aws:' || turn WHEN turn = 0 THEN '{TAG}'
            ELSE 'turn №' || turn || ' (' || role || ')' END AS tag_key FROM conversations)
        WHERE tag_key <> '{TAG}' AND tag_key <> '{TAG}-id' AND tag_key NOT LIKE 'aws:%'""",
    ),
    "snapshot_tags": (
        ("snapshots",),
        """SELECT snapshot_id, 'Purpose _1_' AS tag_key, kind || ' _' || user_id AS tag_value FROM snapshots""",
    ),
    "name_tag": (("volumes",), "SELECT region, volume_id, volume_name FROM volumes"),
    "volume_type": (
        (),
        """SELECT p_partkey, size_gb, requested,
          CASE WHEN requested <> 'auto' THEN requested WHEN size_gb > 1024 THEN 'gp2' ELSE 'standard' END AS volume_type
        FROM (SELECT p_partkey, CAST(round(p_retailprice + p_size * 5) AS BIGINT) AS size_gb,
          CASE WHEN p_type = 'PROMO' THEN 'io1' ELSE 'auto' END AS requested FROM part)""",
    ),
    "upload_plan": (
        (),
        """SELECT l_orderkey, l_linenumber, uncompressed_bytes, codec, level, streams, codec IN ('lz4', 'zstd') AS codec_ok,
          part_bytes, CAST(ceil(uncompressed_bytes / part_bytes) AS BIGINT) AS parts, part_bytes * streams AS memory_bytes,
          round(ceil(uncompressed_bytes / part_bytes) * (0.005::DOUBLE / 1000), 9) AS request_cost
        FROM (SELECT *, CAST(greatest(ceil((uncompressed_bytes + 10485760) / 9000), 5242880) AS BIGINT) AS part_bytes
          FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 10000000) AS BIGINT) AS uncompressed_bytes,
            CASE l_returnflag WHEN 'A' THEN 'lz4' WHEN 'N' THEN 'zstd' ELSE 'none' END AS codec,
            CAST(least(greatest(floor(l_quantity - 10.5 + 0.5), 1), 19) AS BIGINT) AS level,
            CAST(greatest(l_linenumber - 1, 1) AS BIGINT) AS streams FROM lineitem))""",
    ),
    "status_transition": (
        ("outcomes",),
        """SELECT snapshot_id, mode, ok, prior_tag, CASE
          WHEN mode = 'migrate' AND ok AND inline_validate THEN 'validated' WHEN mode = 'migrate' AND ok THEN 'migrated'
          WHEN mode = 'migrate' THEN 'migrate' WHEN ok THEN 'validated'
          WHEN prior_tag IN ('validated', 'validating') THEN 'migrated' WHEN prior_tag IS NULL THEN '' ELSE prior_tag END AS new_tag
        FROM outcomes""",
    ),
    "reusable_volumes": (
        ("snapshots",),
        """SELECT snapshot_id, min('tmp-' || p_partkey) AS reusable_volume_id
        FROM part JOIN snapshots ON snapshot_id = 'snap-' || p_size || 'click'
        WHERE p_name NOT LIKE 'red%' AND p_retailprice < 950 AND p_type NOT IN ('PROMO', 'LARGE') GROUP BY snapshot_id""",
    ),
    "outcome_rollup": (
        ("outcomes",),
        "SELECT mode, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM outcomes GROUP BY mode",
    ),
    "outcome_report": (
        ("outcomes",),
        """SELECT row_number() OVER (ORDER BY section, part, snapshot_id) AS position, line FROM (
          SELECT CASE WHEN ok THEN 0 ELSE 1 END AS section, 1 AS part, snapshot_id,
            CASE WHEN ok THEN snapshot_id ELSE snapshot_id || ': ' || message END AS line FROM outcomes WHERE mode = 'validate'
          UNION ALL SELECT DISTINCT CASE WHEN ok THEN 0 ELSE 1 END, 0, '', CASE WHEN ok THEN 'These snapshots validated successfully:'
            ELSE 'These snapshots failed to validate:' END FROM outcomes WHERE mode = 'validate')""",
    ),
}


def _needed(names: tuple[str, ...], found: list[str]) -> list[str]:
    for name in names:
        _needed(_PARTS[name][0], found)
        if name not in found:
            found.append(name)
    return found


def _statement(parts: tuple[str, ...], select: str) -> str:
    named = ",\n".join(f"{name} AS ({_PARTS[name][1]})" for name in _needed(parts, []))
    if not named:
        return select
    if select.startswith("WITH "):
        return f"WITH {named},\n{select[len('WITH '):]}"
    return f"WITH {named}\n{select}"


ORACLE_SQL: dict[str, str] = {name: _statement(*query) for name, query in _QUERIES.items()}
