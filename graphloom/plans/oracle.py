"""The queries in DuckDB SQL, by other means than the library's: windows in recursive queries instead of folds."""

from __future__ import annotations

_GRAPHS = {
    "bip": (
        "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS n",
        "SELECT DISTINCT l_partkey AS a, (SELECT count(*) FROM part) + l_suppkey AS b FROM lineitem",
    ),
    "path": (
        "SELECT count(*) AS n FROM events",
        "SELECT a, b FROM (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL",
    ),
    "star": (
        "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS n",
        "SELECT o_custkey AS a, (SELECT count(*) FROM customer) + o_orderkey AS b FROM orders",
    ),
}


def _graph(name: str, prefix: str = "") -> str:
    """Common tables n, e(src, dst, pos), d(v, degree) of a graph."""
    n, pairs = _GRAPHS[name]
    p = prefix
    return f"""{p}n AS ({n}), {p}p AS ({pairs}),
    {p}e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst)::INTEGER - 1 AS pos FROM (SELECT a AS src, b AS dst FROM {p}p UNION ALL SELECT b, a FROM {p}p)),
    {p}d AS (SELECT v, (SELECT count(*) FROM {p}e WHERE src = v) AS degree FROM (SELECT unnest(range((SELECT n FROM {p}n))) AS v))"""


def _stats() -> str:
    one = """SELECT '{0}' AS graph, count(*) AS n, sum(degree)::BIGINT AS nnz, sum(degree)::BIGINT // 2 AS n_edges, sum(degree)::DOUBLE / count(*) AS avg_degree,
      min(degree) AS min_degree, max(degree) AS max_degree, list_sort(list(degree))[count(*) // 2 + 1] AS median_degree,
      count(*) FILTER (degree BETWEEN 2 AND 4)::DOUBLE / count(*) AS share_2_to_4 FROM {0}_d"""
    return f"WITH {', '.join(_graph(g, g + '_') for g in _GRAPHS)}, s AS ({' UNION ALL '.join(one.format(g) for g in _GRAPHS)})"


_GRID = """v AS (SELECT unnest(range({g} * {g})) AS v),
  c AS (SELECT v AS src, unnest([v, CASE WHEN v >= {g} THEN v - {g} END, CASE WHEN v < {g} * ({g} - 1) THEN v + {g} END, CASE WHEN v % {g} > 0 THEN v - 1 END, CASE WHEN v % {g} < {g} - 1 THEN v + 1 END]) AS dst,
    unnest([0, 1, 2, 3, 4]) AS k FROM v),
  e AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k)::INTEGER - 1 AS pos, CASE WHEN src = dst THEN 4.0 ELSE -1.0 END::DOUBLE AS w FROM c WHERE dst IS NOT NULL)"""

# The least of 21 widths around the root that divides n.
_SIDE = "(SELECT CASE WHEN w IS NULL THEN r ELSE greatest(w, n // w) END FROM (SELECT n, floor(sqrt(n))::BIGINT AS r, list_min(list_filter(range(greatest(1, floor(sqrt(n))::BIGINT - 10), floor(sqrt(n))::BIGINT + 11), lambda x: n % x = 0)) AS w FROM n))"


def _tree(g: str) -> str:
    """Recursive table t: vertices of every node, with what is cut there. g is SQL for the grid's side, 0 for none."""
    return f"""gg AS (SELECT {g}::BIGINT AS g),
  t AS (
    SELECT v, 1::BIGINT AS node, 0 AS level, 0::BIGINT AS sx, (SELECT g FROM gg) AS w, '' AS path, NULL::VARCHAR AS kind, NULL::BIGINT AS r, NULL::BIGINT AS s, false AS own FROM (SELECT unnest(range((SELECT n FROM n))) AS v)
    UNION ALL
    SELECT v, CASE WHEN own THEN node ELSE node * 2 + (r % 2) END, CASE WHEN own THEN level ELSE level + 1 END, CASE WHEN own THEN sx ELSE sx + (r % 2) * (w // 2) END,
      CASE WHEN own THEN w ELSE w // 2 END, CASE WHEN own THEN path ELSE path || (r % 2) END, kind, r, s, own
    FROM (
      SELECT v, node, level, sx, w, path, s, kind, row_number() OVER (PARTITION BY node, own ORDER BY v) - 1 AS r, own
      FROM (
        SELECT *, CASE WHEN s <= 128 THEN 'leaf' WHEN geo AND hits > 0 THEN 'geometric' WHEN geo THEN 'geo_fallback' ELSE 'spectral' END AS kind,
          s <= 128 OR CASE WHEN geo AND hits > 0 THEN hit ELSE place >= s // 2 - greatest(1, s // 20) // 2 AND place < s // 2 - greatest(1, s // 20) // 2 + greatest(1, s // 20) END AS own
        FROM (
          SELECT *, row_number() OVER (PARTITION BY node ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY node) AS s, sum(hit::INTEGER) OVER (PARTITION BY node) AS hits
          FROM (SELECT v, node, level, sx, w, path, g > 0 AND w > 8 AND g > 8 AS geo,
              g > 0 AND v % greatest(g, 1) >= sx AND v % greatest(g, 1) < sx + w AND v // greatest(g, 1) < g AND (v % greatest(g, 1) - sx = w // 2 OR v // greatest(g, 1) = g // 2) AS hit
            FROM t, gg WHERE NOT own)
        )
      )
    )
  ), o AS (SELECT DISTINCT v, node, level, path, kind, s FROM t WHERE own)"""


_ORDER = "SELECT row_number() OVER (ORDER BY path || '2', v) - 1 AS new_idx, v FROM o"
_NODES = """SELECT node AS node_id, level::INTEGER AS level, kind, any_value(s) AS n_in, count(*) AS sep_size, (any_value(s) - count(*) + 1) // 2 AS a_size, (any_value(s) - count(*)) // 2 AS b_size,
  (SELECT count(*) FROM o x WHERE x.path || '2' < o.path || '0') AS "offset" FROM o GROUP BY node, level, kind, path"""

_SLICE = "place >= n // 2 - greatest(1, n // 20) // 2 AND place < n // 2 - greatest(1, n // 20) // 2 + greatest(1, n // 20)"
_ROOT = f"""i AS (SELECT v, v AS place, n FROM (SELECT unnest(range(n)) AS v, n FROM n)),
  sep AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS sep_pos FROM i WHERE CASE WHEN n <= 128 THEN place = n // 2 ELSE {_SLICE} END),
  sides AS (SELECT v, CASE WHEN r % 2 = 0 THEN 'A' ELSE 'B' END AS side, r // 2 AS side_pos FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM i WHERE v NOT IN (SELECT v FROM sep)))"""

ORACLE: dict[str, str] = {
    "degree": f"WITH {_graph('bip')} SELECT v, degree FROM d",
    "degree_legacy": f"WITH {_graph('bip')} SELECT v, coalesce(lag(degree) OVER (ORDER BY v), 0) AS degree FROM d",
    "degree_stats": f"{_stats()} SELECT graph, n, nnz, n_edges, round(avg_degree, 9) AS avg_degree, min_degree, max_degree, median_degree FROM s",
    "degree_histogram": f"WITH {_graph('star')} SELECT degree, count(*) AS n_vertices FROM d GROUP BY degree",
    "classify_graph": f"{_stats()} SELECT graph, round(share_2_to_4, 9) AS share_2_to_4, share_2_to_4 > 0.8 AS structured FROM s",
    "fill_estimate": f"{_stats()} SELECT graph, round(CASE WHEN share_2_to_4 > 0.8 THEN (1 - n * log2(n) / pow(n, 1.5)) * 100 ELSE least(50, 10 * log10(nnz::DOUBLE / n)) END, 6) AS fill_reduction FROM s",
    "grid_dims": """SELECT n, coalesce(w, r) AS width, coalesce(n // w, r) AS height FROM (SELECT n, r, (SELECT min(x) FROM (SELECT unnest(range(greatest(1, r - 10), r + 11)) AS x) WHERE n % x = 0) AS w
      FROM (SELECT DISTINCT o_orderkey + 1 AS n, floor(sqrt(o_orderkey + 1))::BIGINT AS r FROM orders))""",
    "grid_stencil": f"WITH {_GRID.format(g=50)} SELECT src, dst, pos, w FROM e",
    "laplacian": f"WITH {_GRID.format(g=20)} SELECT src, dst, pos, CASE WHEN src = dst THEN count(*) OVER (PARTITION BY src) ELSE -1 END::DOUBLE AS w FROM e",
    "csr_row_ptr": f"""WITH {_graph("bip")}, x AS (SELECT v, degree FROM d UNION ALL SELECT n, 0 FROM n), y AS (SELECT v, coalesce(sum(degree) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_ptr FROM x)
      SELECT v, row_ptr, coalesce(lag(row_ptr) OVER (ORDER BY v), 0) AS legacy_row_ptr FROM y""",
    "load_csr": f"WITH {_graph('star')} SELECT src, dst, pos, 1.0::DOUBLE AS w FROM e",
    "geometric_mask": f"WITH {_graph('path')}, g AS (SELECT {_SIDE} AS g) SELECT v, (v // g < g AND (v % g = g // 2 OR v // g = g // 2))::INTEGER AS in_separator FROM d, g",
    "geometric_separator": f"WITH {_graph('path')}, g AS (SELECT {_SIDE} AS g) SELECT v, row_number() OVER (ORDER BY v) - 1 AS sep_pos FROM d, g WHERE v // g < g AND (v % g = g // 2 OR v // g = g // 2)",
    "median_slice": f"WITH {_graph('bip')}, {_ROOT} SELECT v, sep_pos FROM sep",
    "rank_partition": f"WITH {_graph('bip')}, x AS (SELECT v, row_number() OVER (ORDER BY degree, v) - 1 AS place FROM d) SELECT v, row_number() OVER (ORDER BY place) - 1 AS sep_pos FROM x, n WHERE {_SLICE}",
    "general_geometric": f"""WITH {_graph("star")}, x AS (SELECT v, row_number() OVER (ORDER BY v % floor(sqrt(n))::BIGINT, v) - 1 AS place, n FROM d, n)
      SELECT v, row_number() OVER (ORDER BY place) - 1 AS sep_pos FROM x WHERE place >= n // 2 - greatest(1, n * 3 // 100) // 2 AND place < n // 2 - greatest(1, n * 3 // 100) // 2 + greatest(1, n * 3 // 100)""",
    "multilevel_separator": f"""WITH {_graph("path")}, h AS (SELECT (n + 1) // 2 AS n FROM n), coarse AS (SELECT v, v // 2 AS place, h.n FROM d, h WHERE v % 2 = 0),
      s AS (SELECT v, row_number() OVER (ORDER BY place) - 1 AS sep_pos FROM coarse WHERE {_SLICE}),
      seen AS (SELECT dst AS v, min(sep_pos * 1000000 + pos) AS sight FROM e JOIN s ON e.src = s.v WHERE dst NOT IN (SELECT v FROM s) GROUP BY dst)
      SELECT v, sep_pos FROM s UNION ALL SELECT v, row_number() OVER (ORDER BY sight) - 1 + (SELECT count(*) FROM s) FROM seen""",
    "alternating_split": f"WITH {_graph('star')}, {_ROOT} SELECT v, side, side_pos FROM sides",
    "order_general": f"WITH RECURSIVE {_graph('bip')}, {_tree('0')} {_ORDER}",
    "order_structured": f"WITH RECURSIVE {_graph('path')}, {_tree(_SIDE)} {_ORDER}",
    "order_grid": f"WITH RECURSIVE n AS (SELECT 2500 AS n), {_tree('50')} {_ORDER}",
    "tree_nodes": f"WITH RECURSIVE {_graph('star')}, {_tree('0')} {_NODES}",
    "tree_nodes_structured": f"WITH RECURSIVE {_graph('path')}, {_tree(_SIDE)} {_NODES}",
    "separator_quality": f"""WITH RECURSIVE {_graph("star")}, {_tree("0")}, x AS ({_NODES})
      SELECT node_id, round((1 - abs(a_size - b_size) / (a_size + b_size)::DOUBLE) * (1 - sep_size / (sep_size + a_size + b_size)::DOUBLE), 9) AS quality, round(least(a_size, b_size) / greatest(a_size, b_size)::DOUBLE, 9) AS balance FROM x WHERE kind <> 'leaf'""",
    "refine_separator": f"""WITH {_graph("bip")}, {_ROOT}, c AS (SELECT sep.v, sep_pos, count(*) FILTER (side = 'A') AS a, count(*) FILTER (side = 'B') AS b FROM sep LEFT JOIN e ON e.src = sep.v LEFT JOIN sides ON sides.v = e.dst GROUP BY sep.v, sep_pos),
      gone AS (SELECT v FROM c WHERE abs(a - b) >= 3 ORDER BY sep_pos LIMIT 5) SELECT v, sep_pos FROM sep WHERE v NOT IN (SELECT v FROM gone)""",
    "edge_cut": f"WITH {_graph('bip')}, {_ROOT} SELECT count(*) AS edge_cut FROM e JOIN sides a ON a.v = e.src AND a.side = 'A' JOIN sides b ON b.v = e.dst AND b.side = 'B'",
    "edge_count_check": f"WITH {_graph('bip')} SELECT (SELECT n FROM n) AS n, (SELECT count(*) FROM lineitem) AS m, count(*) AS n_entries, abs(count(*) - 2 * (SELECT count(*) FROM lineitem)) > 0.1 * (SELECT count(*) FROM lineitem) AS edge_count_warning FROM e",
    "metis_tokens": f"WITH {_graph('star')} SELECT src, dst, pos, 1.0::DOUBLE AS w FROM e",
    "metis_file": f"""WITH {_graph("star")} SELECT d.v, (d.v % 11 + 1)::INTEGER AS size, (d.v % 3)::DOUBLE AS weight_1, (d.v % 5 + 0.25)::DOUBLE AS weight_2, pos, dst, ((src + dst) % 7 + 0.5)::DOUBLE AS w
      FROM d LEFT JOIN e ON e.src = d.v""",
    "matvec": f"WITH {_GRID.format(g=50)} SELECT src AS v, sum(w * dst)::DOUBLE AS y FROM e GROUP BY src",
    "global_rank": f"WITH {_graph('star')} SELECT v, degree, row_number() OVER (ORDER BY degree DESC, v) - 1 AS rank FROM d",
}
