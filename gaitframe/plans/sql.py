"""Common table expressions of the check SQL (DuckDB), mirroring the plans in ``sensor.py``."""

import re

SENSORS = ["ax", "ay", "az", "gx", "gy", "gz"]

CTES = {
    "sensor": """
  SELECT dataset_id,
    concat(dataset_id, CASE WHEN dataset_id <> 'sisfall' THEN '_' WHEN s_acctbal < 4500 THEN '_older' ELSE '_young' END,
           CAST(l_suppkey AS VARCHAR)) AS subject_id,
    concat(dataset_id, '_', CAST(l_suppkey AS VARCHAR), '_r', CAST(CAST(floor(i / 500.0) AS BIGINT) AS VARCHAR)) AS recording_id,
    CAST(1600000000000 + i * 20 + 1000 * CAST(floor(i / 250.0) AS BIGINT) AS BIGINT) AS timestamp,
    CAST((l_quantity - 25.5) / 2.0 + CASE WHEN l_partkey % 97 = 0 THEN 40.0 ELSE 0.0 END AS DOUBLE) AS ax,
    CAST((l_discount - 0.05) * 100 AS DOUBLE) AS ay,
    CAST(CAST(9.8 AS DOUBLE) + (l_tax - 0.04) * 100 AS DOUBLE) AS az,
    CASE WHEN dataset_id = 'unimib_shar' THEN NULL ELSE CAST(l_partkey % 100 - 50 AS DOUBLE) / 25 END AS gx,
    CASE WHEN dataset_id = 'unimib_shar' THEN NULL ELSE CAST(l_orderkey % 100 - 50 AS DOUBLE) / 40 END AS gy,
    CASE WHEN dataset_id = 'unimib_shar' THEN NULL ELSE CAST(l_linenumber - 4 AS DOUBLE) / 3 END AS gz,
    CASE (CAST(floor(i / 75.0) AS BIGINT) + l_suppkey) % 6 WHEN 0 THEN 'standing' WHEN 1 THEN 'walking'
      WHEN 2 THEN 'running' WHEN 3 THEN 'sitting' WHEN 4 THEN 'lying' ELSE 'falling' END AS label,
    CASE l_suppkey % 3 WHEN 0 THEN 'waist_belt' WHEN 1 THEN 'wrist' ELSE 'trouser_right_pocket' END AS phone_position
  FROM (SELECT li.*, s.s_acctbal,
          CASE n.n_regionkey WHEN 0 THEN 'unimib_shar' WHEN 1 THEN 'mobiact' WHEN 2 THEN 'sisfall'
            WHEN 3 THEN 'kfall' ELSE 'own' END AS dataset_id,
          row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS i
        FROM lineitem li JOIN supplier s ON li.l_suppkey = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey) d""",
    "clean": """
  SELECT dataset_id, subject_id, recording_id, timestamp, ax, ay, az, coalesce(gx, 0.0) AS gx,
    coalesce(gy, 0.0) AS gy, coalesce(gz, 0.0) AS gz, label, phone_position, gx IS NOT NULL AS has_gyro
  FROM sensor
  WHERE abs(ax) <= 40 AND abs(ay) <= 40 AND abs(az) <= 40
    AND coalesce(abs(gx) <= 35 AND abs(gy) <= 35 AND abs(gz) <= 35, true)""",
    "cuts": """
  SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY recording_id ORDER BY timestamp) > 500
    THEN 1 ELSE 0 END AS cut FROM clean""",
    "seg0": """
  SELECT *, CAST(sum(cut) OVER (PARTITION BY recording_id ORDER BY timestamp
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS segment FROM cuts""",
    "seg": """
  SELECT *, row_number() OVER (PARTITION BY recording_id, segment ORDER BY timestamp) - 1 AS pos FROM seg0""",
    "wr": """
  SELECT *, pos // 50 AS k, pos % 50 AS spot FROM seg
  UNION ALL SELECT *, pos // 50 - 1 AS k, pos % 50 + 50 AS spot FROM seg WHERE pos >= 50""",
    "wcount": """
  SELECT recording_id, segment, k, label, count(*) AS n, min(timestamp) AS start_ts,
    min(subject_id) AS subject_id, min(dataset_id) AS dataset_id
  FROM wr GROUP BY recording_id, segment, k, label""",
    "wall": """
  SELECT recording_id, segment, k, sum(n) AS n_rows, min(start_ts) AS start_ts, min(subject_id) AS subject_id,
    min(dataset_id) AS dataset_id, max(n) / sum(n) AS purity, bool_or(label = 'falling') AS has_fall,
    first(label ORDER BY n DESC, label) AS top
  FROM wcount GROUP BY recording_id, segment, k HAVING sum(n) = 100""",
    "win": """
  SELECT recording_id, segment, k, start_ts, subject_id, dataset_id, purity, has_fall,
    CASE WHEN has_fall THEN 'falling' ELSE top END AS label
  FROM wall WHERE has_fall OR purity >= 0.6""",
    "wrow": """
  SELECT wr.recording_id, wr.segment, wr.k, wr.spot, wr.timestamp, ax, ay, az, gx, gy, gz, wr.label AS row_label,
    win.label, win.subject_id, win.dataset_id
  FROM wr JOIN win ON wr.recording_id = win.recording_id AND wr.segment = win.segment AND wr.k = win.k""",
    "pred": """
  SELECT *, coalesce(lag(label) OVER (PARTITION BY recording_id ORDER BY segment, k), 'walking') AS prediction
  FROM win""",
}


def with_ctes(body: str, *extra: tuple[str, str]) -> str:
    """``WITH`` the expressions that ``body`` needs, in order, then ``body``."""
    parts = {**CTES, **dict(extra)}
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in parts:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                need(parts[name])

    need(body)
    if not needed:
        return body
    order = [n for n in parts if n in needed]
    return "WITH " + ",\n".join(f"{n} AS ({parts[n]})" for n in order) + "\n" + body


def r6(expression: str, alias: str) -> str:
    """Six decimals, without negative zero."""
    return f"round({expression}, 6) + 0.0 AS {alias}"
