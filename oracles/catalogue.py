"""Oracle SQL for every query of ``denseblocks.plans.queries.catalogue()``."""

from __future__ import annotations

from .sql import (
    N3,
    best_density_sql,
    block_sql,
    blocks_sql,
    cards_cte,
    density_expr,
    digits,
    find_block_sql,
    find_blocks_report_sql,
    first_pass_sql,
    gaps,
    inside,
    member_ranges_sql,
    passes_sql,
    prod_expr,
    sum_expr,
    value_masses,
    with_rel,
)


def _profile(rel: str) -> str:
    bad = " OR ".join(["v IS NULL", "v < 1"] + [f"a{i} IS NULL OR a{i} < 0" for i in range(N3)])
    cards = ", ".join(f"CAST(coalesce(max(a{i}) + 1, 0) AS BIGINT) AS card_{i}" for i in range(N3))
    return with_rel(rel) + (
        f"\nSELECT CAST(count(*) AS BIGINT) AS tuples, CAST(coalesce(sum(v), 0) AS BIGINT) AS mass, {cards}, "
        f"CAST(sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM {rel}"
    )


def _value_masses(rel: str) -> str:
    return with_rel(rel) + "\n" + value_masses(rel)


def _value_masses_filled(rel: str) -> str:
    return with_rel(rel, cards_cte(rel)) + (
        f"\nSELECT a.mode, a.value, CAST(coalesce(s.mass, 0) AS BIGINT) AS mass "
        f"FROM (SELECT mode, unnest(range(0, c)) AS value FROM CARDS) a "
        f"LEFT JOIN ({value_masses(rel)}) s ON a.mode = s.mode AND a.value = s.value"
    )


def _mass_check(rel: str) -> str:
    return with_rel(rel) + (
        f"\nSELECT mode, CAST(sum(mass) AS BIGINT) AS mass, CAST(count(*) AS BIGINT) AS n_values "
        f"FROM ({value_masses(rel)}) vm GROUP BY mode"
    )


def _mass_histogram(rel: str) -> str:
    return with_rel(rel) + f"\nSELECT mode, mass, CAST(count(*) AS BIGINT) AS cnt FROM ({value_masses(rel)}) vm GROUP BY mode, mass"


def _full(rel: str):
    full = [f"(SELECT c FROM CARDS WHERE mode = {i})" for i in range(N3)]
    m0 = f"(SELECT CAST(sum(v) AS BIGINT) FROM {rel})"
    return full, m0, prod_expr(full)


def _start_density(rel: str) -> str:
    full, m0, p0 = _full(rel)
    cols = ", ".join(
        f"round({density_expr(m, m0, p0, sum_expr(full), N3, m0, p0)}, {digits(m)}) AS density_{m}"
        for m in ("ari", "geo", "susp")
    )
    return with_rel(rel, cards_cte(rel)) + f"\nSELECT {cols}"


def _block_density(rel: str, measure: str) -> str:
    full, m0, p0 = _full(rel)
    cards = [full[0], full[1], "1"]
    d = density_expr(measure, "x.mass", prod_expr(cards), sum_expr(cards), N3, m0, p0)
    return with_rel(rel, cards_cte(rel)) + (
        f"\nSELECT x.value, x.mass, round({d}, {digits(measure)}) AS density FROM "
        f"(SELECT a2 AS value, CAST(sum(v) AS BIGINT) AS mass FROM {rel} GROUP BY a2) x"
    )


def _first(select: str, measure: str = "geo", policy: str = "density") -> str:
    return first_pass_sql("P", measure, policy, 2.0, select)


def _update_masses() -> str:
    return _first(
        f"SELECT v.mode, v.value, v.mass, v.rpass FROM V1 v WHERE EXISTS "
        f"(SELECT 1 FROM ({value_masses('P')}) s WHERE s.mode = v.mode AND s.value = v.value)"
    )


def _lines() -> str:
    qty = "CASE WHEN l_returnflag = 'R' THEN l_returnflag ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END"
    full = f"concat_ws(',', l_partkey, l_suppkey, l_linenumber, {qty}, l_orderkey)"
    short = f"concat_ws(',', l_partkey, l_suppkey, {qty})"
    tok = "string_split(regexp_replace(line, ',+$', ''), ',')"
    cols = []
    for i in range(N3 + 1):
        t = f"(CASE WHEN len(t) >= {i + 1} THEN t[{i + 1}] END)"
        cols.append(
            f"CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN TRY_CAST({t} AS BIGINT) END AS "
            + (f"a{i}" if i < N3 else "v")
        )
    ok = " AND ".join([f"a{i} IS NOT NULL" for i in range(N3)] + ["v IS NOT NULL"])
    valid = " AND ".join(["v >= 1"] + [f"a{i} >= 0" for i in range(N3)])
    return (
        f"WITH LINES AS (SELECT CASE WHEN l_linenumber = 7 THEN {short} ELSE {full} END AS line FROM lineitem),\n"
        f"TOK AS (SELECT line, {tok} AS t FROM LINES),\n"
        f"PARSED AS (SELECT line, len(t) AS n, {', '.join(cols)} FROM TOK),\n"
        f"CLS AS (SELECT line, a0, a1, a2, v, CASE WHEN n < {N3 + 1} THEN 'short' WHEN NOT ({ok}) THEN 'bad_token' "
        f"WHEN NOT ({valid}) THEN 'invalid' END AS reason FROM PARSED)\n"
    )


def _text_counters() -> str:
    reasons = ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("short", "bad_token", "invalid"))
    cards = ", ".join(f"max(a{i}) FILTER (reason IS NULL) + 1 AS card_{i}" for i in range(N3))
    return _lines() + f"SELECT count(*) AS lines, {reasons}, count(*) FILTER (reason IS NULL) AS tuples, CAST(sum(v) FILTER (reason IS NULL) AS BIGINT) AS mass, {cards} FROM CLS"


def _value_mass_ranges(rel: str) -> str:
    return with_rel(rel, cards_cte(rel)) + (
        f'\nSELECT mode, value AS "from", value AS "to", mass FROM ({value_masses(rel)}) s\nUNION ALL\nSELECT mode, "from", "to", CAST(0 AS BIGINT) FROM ({gaps(rel, "CARDS")}) g'
    )


def _single_removal() -> str:
    """Density if only the lightest value of each dimension went."""
    cur = [f"(SELECT c FROM CARDS WHERE mode = {i})" for i in range(N3)]
    m0 = "(SELECT M FROM SMASS)"
    p0 = prod_expr(cur)
    c = "CASE " + " ".join(f"WHEN x.mode = {i} THEN {cur[i]}" for i in range(N3)) + " END"
    scaled = f"({p0} / CAST({c} AS DOUBLE) * CAST({c} - 1 AS DOUBLE))"
    d = density_expr("geo", f"({m0} - x.mass)", scaled, f"({sum_expr(cur)} - 1)", N3, m0, p0)
    return first_pass_sql(
        "P", "geo", "density", 2.0,
        f"SELECT x.mode, x.mass, round({d}, 6) AS score FROM (SELECT mode, min(mass) AS mass FROM V0 GROUP BY mode) x",
    )


def _empty_report() -> str:
    cols = "0::INTEGER AS block, 0::BIGINT AS card_0, 0::BIGINT AS card_1, 0::BIGINT AS card_2, 0::BIGINT AS mass, 0::BIGINT AS tuples, 0::DOUBLE AS density, 0::DOUBLE AS search_density, 0::BIGINT AS search_mass, 0::INTEGER AS passes, 0::INTEGER AS passes_run"
    return f"WITH NONE_LEFT AS (SELECT * FROM lineitem WHERE l_quantity < 0)\nSELECT {cols} FROM NONE_LEFT"


def _dictionary() -> str:
    """Ids of order keys as strings, in the order of the strings."""
    return "WITH KEYS AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey IS NOT NULL)\nSELECT k AS key, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS id FROM KEYS"


def _rejected() -> str:
    """Profile of lineitem with null keys and fractional measures, invalid tuples counted."""
    flags = "(SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT nullif(l_returnflag, 'R') AS key FROM lineitem) k WHERE key IS NOT NULL)"
    half = "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 2 ELSE l_quantity END"
    rows = f"SELECT CAST(l_partkey AS BIGINT) AS a0, CAST(l_suppkey AS BIGINT) AS a1, f.id AS a2, CASE WHEN {half} = floor({half}) THEN CAST({half} AS BIGINT) END AS v FROM lineitem LEFT JOIN {flags} f ON lineitem.l_returnflag = f.key"
    bad = " OR ".join(["v IS NULL", "v < 1"] + [f"a{i} IS NULL OR a{i} < 0" for i in range(N3)])
    cards = ", ".join(f"CAST(coalesce(max(a{i}) + 1, 0) AS BIGINT) AS card_{i}" for i in range(N3))
    return f"WITH R AS ({rows})\nSELECT CAST(count(*) AS BIGINT) AS tuples, CAST(coalesce(sum(v), 0) AS BIGINT) AS mass, {cards}, CAST(sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM R"


def catalogue() -> dict[str, str]:
    q = {
        "profile_L": _profile("L"),
        "profile_E": _profile("E"),
        "value_masses_L": _value_masses("L"),
        "value_masses_filled_E": _value_masses_filled("E"),
        "mass_check_L": _mass_check("L"),
        "mass_histogram_L": _mass_histogram("L"),
        "start_density_L": _start_density("L"),
        "candidates_theta2_P": _first("SELECT mode, k, s FROM G1"),
        "prefix_densities_geo_P": _first("SELECT mode, mass, k, s, round(d, 6) AS density FROM D1 QUALIFY row_number() OVER (PARTITION BY mode, mass ORDER BY k DESC) = 1"),
        "best_cut_geo_P": _first("SELECT mode, round(d, 6) AS best_density, mass AS best_mass FROM BE1"),
        "choose_mode_density_P": _first("SELECT mode FROM CH1"),
        "choose_mode_cardinality_P": _first("SELECT mode FROM CH1", policy="cardinality"),
        "remove_values_P": _first("SELECT a0, a1, a2, v FROM B1"),
        "update_masses_recompute_P": _update_masses(),
        "update_masses_delta_P": _update_masses(),
        "block_tuples_P": block_sql("P", "geo", "density", 2.0, "SELECT a0, a1, a2, v FROM BT1"),
        "block_mass_P": block_sql(
            "P", "geo", "density", 2.0,
            "SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS mass, CAST(count(*) AS BIGINT) AS tuples FROM BT1",
        ),
        "block_cardinalities_P": block_sql(
            "P", "geo", "density", 2.0, "SELECT mode, CAST(count(*) AS BIGINT) AS n_values FROM MEMBERS1 GROUP BY mode"
        ),
        "deflate_P": block_sql("P", "geo", "density", 2.0, f"SELECT r.* FROM P r WHERE NOT ({inside('r', 'MEMBERS1')})"),
        "parse_text_L": _lines() + "SELECT a0, a1, a2, v FROM CLS WHERE reason IS NULL",
        "malformed_L": _lines() + "SELECT line, reason FROM CLS WHERE reason IS NOT NULL",
    }
    for m in ("ari", "geo", "susp"):
        q[f"block_density_{m}_L"] = _block_density("L", m)
        q[f"mode_scores_{m}_P"] = _first(f"SELECT mode, k, s, round(score, {digits(m)}) AS score FROM SC1", measure=m)
        for pol in ("density", "cardinality"):
            q[f"find_block_{m}_{pol}_P"] = find_block_sql("P", m, pol, 2.0)
            q[f"find_blocks_report_{m}_{pol}_P"] = find_blocks_report_sql("P", m, pol, 2.0)
    q["find_block_susp_density_E"] = find_block_sql("E", "susp", "density", 2.0)
    q["find_blocks_report_susp_density_E"] = find_blocks_report_sql("E", "susp", "density", 2.0)
    q["find_blocks_report_geo_density_L"] = find_blocks_report_sql("L", "geo", "density", 2.0)
    q["find_blocks_report_k2_geo_density_P"] = find_blocks_report_sql("P", "geo", "density", 2.0, k=2)
    q["find_blocks_report_k2_ari_cardinality_P"] = find_blocks_report_sql("P", "ari", "cardinality", 2.0, k=2)
    q["best_density_k2_ari_cardinality_P"] = best_density_sql("P", "ari", "cardinality", 2.0, k=2)
    q["single_removal_scores_geo_P"] = _single_removal()
    q["find_blocks_report_k3_geo_density_theta1_P"] = find_blocks_report_sql("P", "geo", "density", 1.0, k=3)
    q["find_blocks_report_k2_geo_density_H"] = find_blocks_report_sql("H", "geo", "density", 2.0, k=2)
    for way, left_out in {"delta": "", "shuffled": "", "by_value": "passes_run", "early_exit": "passes, passes_run"}.items():
        columns = f"* EXCLUDE ({left_out})" if left_out else "*"
        q[f"find_blocks_report_k2_{way}_P"] = find_blocks_report_sql("P", "geo", "density", 2.0, k=2, columns=columns)
    q["find_blocks_report_distinct_P"] = find_blocks_report_sql("P", "geo", "density", 2.0, unseen="none")
    q["find_blocks_report_empty_L"] = _empty_report()
    for way in ("bitmap", "bucketed", "moved_histogram"):
        q[f"find_blocks_report_k2_{way}_P"] = find_blocks_report_sql("P", "geo", "density", 2.0, k=2)
    q["block_totals_k3_P"] = blocks_sql(
        "P", "ari", "cardinality", 2.0, 3, lambda b, bt: f"SELECT CAST({b} AS INTEGER) AS block, CAST(sum(v) AS BIGINT) AS mass, count(*) AS tuples FROM {bt} HAVING count(*) > 0"
    )
    every = lambda b, bt: f"SELECT CAST({b} AS INTEGER) AS block, a0, a1, a2, v FROM {bt}"
    q["blocks_tuples_k3_P"] = blocks_sql("P", "ari", "cardinality", 2.0, 3, every)
    q["blocks_tuples_k3_F"] = blocks_sql("F", "geo", "density", 2.0, 3, every)
    q["searched_rows_F"] = with_rel("F") + "\nSELECT count(*) AS tuples, count(DISTINCT (a0, a1, a2)) AS n_rows FROM F"
    q["find_blocks_report_k3_geo_density_F"] = find_blocks_report_sql("F", "geo", "density", 2.0, k=3)
    q["find_blocks_report_k6_geo_density_G"] = find_blocks_report_sql("G", "geo", "density", 2.0, k=6, unseen="count")
    q["member_ranges_k6_G"] = member_ranges_sql("G", "geo", "density", 2.0, 6)
    q["value_mass_ranges_G"] = _value_mass_ranges("G")
    q["value_mass_ranges_E"] = _value_mass_ranges("E")
    q["text_counters_L"] = _text_counters()
    q["passes_k2_P"] = passes_sql("P", "geo", "density", 2.0, 2)
    q["passes_k2_moved_histogram_P"] = passes_sql("P", "geo", "density", 2.0, 2, moved=True)
    q["resumed_report_k2_P"] = find_blocks_report_sql("P", "geo", "density", 1.3, k=2)
    q["job_passes_lineitem"] = passes_sql("N", "susp", "cardinality", 2.0, 1, columns="* EXCLUDE (stat_rows), true AS timed")
    q["dictionary_orders"] = _dictionary()
    q["rejected_lineitem"] = _rejected()
    for name, src in (("sink", "P"), ("job_csv", "P"), ("published", "P")):
        q[f"{name}_attributes_{src}"] = block_sql(src, "geo", "density", 2.0, "SELECT CAST(1 AS INTEGER) AS block, m.mode, coalesce(f.key, CAST(m.value AS VARCHAR)) AS value FROM MEMBERS1 m LEFT JOIN L_FLAGS f ON m.mode = 2 AND f.id = m.value")
        q[f"{name}_tuples_{src}"] = block_sql(src, "geo", "density", 2.0, "SELECT CAST(1 AS INTEGER) AS block, CAST(a0 AS VARCHAR) AS a0, CAST(a1 AS VARCHAR) AS a1, f.key AS a2, v FROM BT1 JOIN L_FLAGS f ON f.id = a2")
    return q
