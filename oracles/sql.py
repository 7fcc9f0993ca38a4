"""ANSI SQL (DuckDB dialect) text for the driver's correctness check.

Each function returns SQL over the pre-registered test tables. The peeling
search is a recursive CTE with one row per value, which runs until every value is
removed, however many passes that takes; the first pass alone is also written
out as CTEs of its own, for the queries on its parts. Every pass removes its values one
by one in the order (mass, value). No Spark here: this is the oracle.
"""

from __future__ import annotations

N3 = 3


def dbl(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


# ---------------------------------------------------------------------------
# relations
# ---------------------------------------------------------------------------

REL_L = """
L_FLAGS AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id
            FROM (SELECT DISTINCT l_returnflag AS key FROM lineitem WHERE l_returnflag IS NOT NULL) k),
L AS (SELECT CAST(l_partkey AS BIGINT) AS a0, CAST(l_suppkey AS BIGINT) AS a1, f.id AS a2,
             CAST(l_quantity AS BIGINT) AS v
      FROM lineitem JOIN L_FLAGS f ON lineitem.l_returnflag = f.key)"""

REL_P = REL_L + """,
P AS (SELECT a0, a1, a2, v FROM L
      UNION ALL
      SELECT CAST(range // 5 AS BIGINT), CAST(range % 5 AS BIGINT), CAST(0 AS BIGINT), CAST(20000 AS BIGINT)
      FROM range(50))"""

REL_H = REL_L + """,
H AS (SELECT a0, a1, a2, v FROM L
      UNION ALL
      SELECT CAST(range // 5 AS BIGINT), CAST(range % 5 AS BIGINT), CAST(0 AS BIGINT), CAST(1000000000 AS BIGINT)
      FROM range(50))"""

REL_E = """
E_TYPES AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id
            FROM (SELECT DISTINCT event_type AS key FROM events WHERE event_type IS NOT NULL) k),
E AS (SELECT CAST(user_id AS BIGINT) AS a0, t.id AS a1,
             CAST((dayofmonth(ts) - 1) * 24 + hour(ts) AS BIGINT) AS a2, CAST(count(*) AS BIGINT) AS v
      FROM events JOIN E_TYPES t ON events.event_type = t.key
      GROUP BY 1, 2, 3)"""

REL_F = REL_L + """,
L_STATES AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS id
             FROM (SELECT DISTINCT l_linestatus AS key FROM lineitem WHERE l_linestatus IS NOT NULL) k),
F AS (SELECT f.id AS a0, s.id AS a1, CAST(l_linenumber AS BIGINT) AS a2, CAST(l_quantity AS BIGINT) AS v
      FROM lineitem JOIN L_FLAGS f ON lineitem.l_returnflag = f.key JOIN L_STATES s ON lineitem.l_linestatus = s.key)"""

REL_G = REL_F + """,
G AS (SELECT a0 * 500000000000 AS a0, a1, a2, v FROM F)"""

REL_N = """
N AS (SELECT CAST(l_partkey AS BIGINT) AS a0, CAST(l_suppkey AS BIGINT) AS a1, CAST(l_linenumber AS BIGINT) AS a2, CAST(l_quantity AS BIGINT) AS v FROM lineitem)"""

RELATIONS = {"L": REL_L, "P": REL_P, "E": REL_E, "H": REL_H, "F": REL_F, "G": REL_G, "N": REL_N}


def with_rel(rel: str, *ctes: str) -> str:
    parts = [RELATIONS[rel].strip()] + [c.strip() for c in ctes if c]
    return "WITH RECURSIVE " + ",\n".join(parts)


def unpivot(src: str, n: int = N3, measure: str = "v") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS INTEGER) AS mode, a{i} AS value, {measure} AS v FROM {src}" for i in range(n)
    )


def value_masses(src: str, n: int = N3) -> str:
    return (
        f"SELECT mode, value, CAST(sum(v) AS BIGINT) AS mass FROM ({unpivot(src, n)}) u GROUP BY mode, value"
    )


def distinct_cards_cte(src: str, n: int = N3) -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS mode, CAST(count(DISTINCT a{i}) AS BIGINT) AS c FROM {src}" for i in range(n))
    return f"CARDS AS ({rows})"


def cards_cte(src: str, n: int = N3) -> str:
    rows = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS mode, CAST(max(a{i}) + 1 AS BIGINT) AS c FROM {src}" for i in range(n)
    )
    return f"CARDS AS ({rows})"


# ---------------------------------------------------------------------------
# density expressions
# ---------------------------------------------------------------------------


def prod_expr(cards: list[str]) -> str:
    out = "CAST(1.0 AS DOUBLE)"
    for c in cards:
        out = f"({out} * CAST({c} AS DOUBLE))"
    return out


def sum_expr(cards: list[str]) -> str:
    return "(" + " + ".join(f"CAST({c} AS BIGINT)" for c in cards) + ")"


def density_expr(measure: str, mass: str, prod: str, csum: str, n: int, m0: str, p0: str) -> str:
    m = f"CAST({mass} AS DOUBLE)"
    if measure == "ari":
        return f"(CASE WHEN CAST({csum} AS DOUBLE) = 0 THEN -1.0 ELSE {m} / CAST({csum} AS DOUBLE) * {n} END)"
    if measure == "geo":
        return f"(CASE WHEN {prod} = 0 THEN -1.0 ELSE {m} / pow({prod}, CAST(1 AS DOUBLE) / {n}) END)"
    if measure == "susp":
        return (
            f"(CASE WHEN {prod} = 0 OR {m} = 0 OR CAST({m0} AS DOUBLE) = 0 THEN -1.0 ELSE "
            f"{m} * (ln({m} / CAST({m0} AS DOUBLE)) - 1) + CAST({m0} AS DOUBLE) * {prod} / {p0} "
            f"- {m} * ln({prod} / {p0}) END)"
        )
    raise ValueError(measure)


def digits(measure: str) -> int:
    return 3 if measure == "susp" else 6


# ---------------------------------------------------------------------------
# the first pass, part by part
# ---------------------------------------------------------------------------


def first_pass_ctes(src: str, measure: str, policy: str, theta: float, n: int = N3, passes: int = 1,
                    prefix: str = "", cards: str = "CARDS") -> tuple[list[str], str]:
    """CTEs of the first pass over relation ``src``; returns (ctes, name of the
    last state). ``cards`` names the CTE of full cardinalities (mode, c) of
    the original relation; every name made here starts with ``prefix``.

    State per pass p: S{p} (one row of scalars), V{p} (every value with its
    mass and removal pass), B{p} (alive tuples).
    """
    X = prefix
    ctes = []
    c_sel = ", ".join(f"(SELECT c FROM {cards} WHERE mode = {i}) AS c{i}" for i in range(n))
    ctes.append(f"{X}SMASS AS (SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS M FROM {src})")
    full = [f"(SELECT c FROM {cards} WHERE mode = {i})" for i in range(n)]
    p0 = prod_expr(full)
    m0 = f"(SELECT M FROM {X}SMASS)"
    start = density_expr(measure, m0, p0, sum_expr(full), n, m0, p0)
    ctes.append(
        f"{X}S0 AS (SELECT CAST(0 AS INTEGER) AS passes, {m0} AS M, {c_sel}, {start} AS best, "
        f"CAST(NULL AS INTEGER) AS cut_pass, CAST(NULL AS BIGINT) AS cut_mass, CAST(NULL AS BIGINT) AS cut_value, CAST(0 AS INTEGER) AS passes_run, CAST(NULL AS INTEGER) AS chosen, "
        f"CAST(NULL AS DOUBLE) AS thr)"
    )
    seen = value_masses(src, n)
    every = f"SELECT mode, unnest(range(0, c)) AS value FROM {cards}"
    ctes.append(
        f"{X}V0 AS MATERIALIZED (SELECT a.mode, a.value, CAST(coalesce(s.mass, 0) AS BIGINT) AS mass, "
        f"CAST(NULL AS INTEGER) AS rpass FROM "
        f"({every}) a "
        f"LEFT JOIN ({seen}) s ON a.mode = s.mode AND a.value = s.value)"
    )
    ctes.append(f"{X}B0 AS MATERIALIZED (SELECT * FROM {src})")
    modes = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS mode" for i in range(n))
    for p in range(1, passes + 1):
        q = p - 1  # 0-based pass number used in rpass
        S = f"{X}S{q}"
        sc = lambda name: f"(SELECT {name} FROM {S})"
        c_of_mode = "CASE " + " ".join(f"WHEN t.mode = {i} THEN {sc(f'c{i}')}" for i in range(n)) + " END"
        ctes.append(
            f"{X}TH{p} AS MATERIALIZED (SELECT t.mode, {c_of_mode} AS c, "
            f"CAST({sc('M')} AS DOUBLE) * {dbl(theta)} / CAST({c_of_mode} AS DOUBLE) AS thr "
            f"FROM ({modes}) t WHERE {c_of_mode} > 0)"
        )
        ctes.append(
            f"{X}H{p} AS MATERIALIZED (SELECT v.mode, v.mass, v.value FROM {X}V{q} v "
            f"JOIN {X}TH{p} t ON v.mode = t.mode WHERE v.rpass IS NULL AND CAST(v.mass AS DOUBLE) <= t.thr)"
        )
        ctes.append(
            f"{X}CA{p} AS MATERIALIZED (SELECT mode, mass, value, "
            f"CAST(row_number() OVER (PARTITION BY mode ORDER BY mass, value) AS BIGINT) AS k, "
            f"CAST(sum(mass) OVER (PARTITION BY mode ORDER BY mass, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s "
            f"FROM {X}H{p})"
        )
        cards_after = [f"(CASE WHEN ca.mode = {i} THEN {sc(f'c{i}')} - ca.k ELSE {sc(f'c{i}')} END)" for i in range(n)]
        d_row = density_expr(measure, f"({sc('M')} - ca.s)", prod_expr(cards_after), sum_expr(cards_after), n, m0, p0)
        ctes.append(f"{X}D{p} AS MATERIALIZED (SELECT ca.mode, ca.mass, ca.value, ca.k, ca.s, {d_row} AS d FROM {X}CA{p} ca)")
        cur = [sc(f"c{i}") for i in range(n)]
        c_g = "CASE " + " ".join(f"WHEN g.mode = {i} THEN {sc(f'c{i}')}" for i in range(n)) + " END"
        prod_scaled = f"({prod_expr(cur)} / CAST({c_g} AS DOUBLE) * CAST({c_g} - g.k AS DOUBLE))"
        score = density_expr(measure, f"({sc('M')} - g.s)", prod_scaled, f"({sum_expr(cur)} - g.k)", n, m0, p0)
        ctes.append(
            f"{X}G{p} AS MATERIALIZED (SELECT mode, max(k) AS k, max(s) AS s FROM {X}D{p} GROUP BY mode)"
        )
        ctes.append(
            f"{X}BE{p} AS MATERIALIZED (SELECT mode, d, mass, value, k, s FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY mode ORDER BY d DESC, k ASC) AS rn FROM {X}D{p}) x WHERE rn = 1)"
        )
        ctes.append(f"{X}SC{p} AS MATERIALIZED (SELECT g.mode, g.k, g.s, {score} AS score, {c_g} AS c FROM {X}G{p} g)")
        pol = "CAST(g.c AS DOUBLE)" if policy == "cardinality" else "g.score"
        ctes.append(
            f"{X}CH{p} AS MATERIALIZED (SELECT g.mode, g.k, g.s, b.d, b.mass AS bmass, b.value AS bvalue, t.thr, {pol} AS pscore "
            f"FROM {X}SC{p} g JOIN {X}BE{p} b ON g.mode = b.mode JOIN {X}TH{p} t ON g.mode = t.mode "
            f"ORDER BY pscore DESC, g.mode DESC LIMIT 1)"
        )
        ch = lambda name: f"(SELECT {name} FROM {X}CH{p})"
        better = f"(coalesce({ch('d')} > {sc('best')}, false))"
        c_new = ", ".join(
            f"{sc(f'c{i}')} - coalesce(CASE WHEN {ch('mode')} = {i} THEN {ch('k')} END, 0) AS c{i}" for i in range(n)
        )
        ctes.append(
            f"{X}S{p} AS MATERIALIZED (SELECT {sc('passes')} + CASE WHEN {ch('mode')} IS NULL THEN 0 ELSE 1 END AS passes, "
            f"{sc('M')} - coalesce({ch('s')}, 0) AS M, {c_new}, "
            f"CASE WHEN {better} THEN {ch('d')} ELSE {sc('best')} END AS best, "
            f"CASE WHEN {better} THEN CAST({q} AS INTEGER) ELSE {sc('cut_pass')} END AS cut_pass, "
            f"CASE WHEN {better} THEN {ch('bmass')} ELSE {sc('cut_mass')} END AS cut_mass, "
            f"CASE WHEN {better} THEN {ch('bvalue')} ELSE {sc('cut_value')} END AS cut_value, "
            f"{sc('passes_run')} + CASE WHEN {ch('mode')} IS NOT NULL AND ({q} = 0 OR {sc('M')} > 0) THEN 1 ELSE 0 END AS passes_run, "
            f"{ch('mode')} AS chosen, {ch('thr')} AS thr)"
        )
        gone = (
            f"v.rpass IS NULL AND v.mode = (SELECT chosen FROM {X}S{p}) "
            f"AND CAST(v.mass AS DOUBLE) <= (SELECT thr FROM {X}S{p})"
        )
        ctes.append(f"{X}RM{p} AS MATERIALIZED (SELECT v.mode, v.value FROM {X}V{q} v WHERE {gone})")
        keep = " AND ".join(f"b.a{i} NOT IN (SELECT value FROM {X}RM{p} WHERE mode = {i})" for i in range(n))
        ctes.append(f"{X}B{p} AS MATERIALIZED (SELECT b.* FROM {X}B{q} b WHERE {keep})")
        ctes.append(f"{X}NM{p} AS MATERIALIZED ({value_masses(f'{X}B{p}', n)})")
        ctes.append(
            f"{X}V{p} AS MATERIALIZED (SELECT v.mode, v.value, "
            f"CASE WHEN v.rpass IS NOT NULL OR coalesce({gone}, false) THEN v.mass "
            f"ELSE CAST(coalesce(nm.mass, 0) AS BIGINT) END AS mass, "
            f"CASE WHEN v.rpass IS NOT NULL THEN v.rpass WHEN coalesce({gone}, false) THEN CAST({q} AS INTEGER) "
            f"ELSE CAST(NULL AS INTEGER) END AS rpass "
            f"FROM {X}V{q} v LEFT JOIN {X}NM{p} nm ON v.mode = nm.mode AND v.value = nm.value)"
        )
    return ctes, f"{X}S{passes}"


# ---------------------------------------------------------------------------
# the whole search
# ---------------------------------------------------------------------------


def peel_ctes(src: str, measure: str, policy: str, theta: float, n: int = N3, prefix: str = "", cards: str = "CARDS", unseen: str = "rows") -> list[str]:
    """CTEs of a full peel of relation ``src``, until no value is left.

    ``{prefix}PEEL`` is the recursion: one row per value and pass, with the scalars of the
    pass in every row; ``{prefix}V`` are its values after the last pass and ``{prefix}S``
    its last scalars. Never-seen ids are ``rows`` of their own, one row of their number
    with value -1 (``count``: they are removed first, and together, since each removal of one
    raises the density), or left out (``none``).
    """
    X = prefix
    full = [f"(SELECT c FROM {cards} WHERE mode = {i})" for i in range(n)]
    m0, p0 = f"(SELECT M FROM {X}SMASS)", prod_expr(full)
    seen = value_masses(src, n)
    every = f"SELECT DISTINCT mode, value, CAST(1 AS BIGINT) AS cnt FROM ({unpivot('ORIGINAL', n)}) u"
    if unseen == "rows":
        every = f"SELECT mode, unnest(range(0, c)) AS value, CAST(1 AS BIGINT) AS cnt FROM {cards}"
    if unseen == "count":
        every = f"SELECT * FROM ({every}) e UNION ALL SELECT k.mode, CAST(-1 AS BIGINT), k.c - s.n FROM {cards} k JOIN (SELECT mode, count(*) AS n FROM ({every}) e GROUP BY mode) s ON k.mode = s.mode WHERE k.c > s.n"
    names = ", ".join(f"c{i}" for i in range(n))
    start = density_expr(measure, m0, p0, sum_expr(full), n, m0, p0)
    base = (
        f"SELECT CAST(0 AS INTEGER) AS p, a.mode, a.value, a.cnt, CAST(coalesce(s.mass, 0) AS BIGINT) AS mass, CAST(NULL AS INTEGER) AS rpass, {m0} AS M, "
        + ", ".join(f"{c} AS c{i}" for i, c in enumerate(full))
        + f", {start} AS best, CAST(NULL AS INTEGER) AS cut_pass, CAST(NULL AS BIGINT) AS cut_mass, CAST(NULL AS BIGINT) AS cut_value, CAST(0 AS INTEGER) AS passes_run, "
        f"CAST(NULL AS INTEGER) AS chosen, CAST(NULL AS BIGINT) AS ck, CAST(NULL AS BIGINT) AS cs "
        f"FROM ({every}) a LEFT JOIN ({seen}) s ON a.mode = s.mode AND a.value = s.value"
    )
    of_mode = lambda alias: "CASE " + " ".join(f"WHEN {alias}.mode = {i} THEN st.c{i}" for i in range(n)) + " END"
    modes = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS mode" for i in range(n))
    after = [f"(CASE WHEN ca.mode = {i} THEN st.c{i} - ca.k ELSE st.c{i} END)" for i in range(n)]
    cur = [f"st.c{i}" for i in range(n)]
    scaled = f"({prod_expr(cur)} / CAST({of_mode('g')} AS DOUBLE) * CAST({of_mode('g')} - g.k AS DOUBLE))"
    score = density_expr(measure, "(st.M - g.s)", scaled, f"({sum_expr(cur)} - g.k)", n, m0, p0)
    pol = f"CAST({of_mode('g')} AS DOUBLE)" if policy == "cardinality" else score
    gone = "(x.mode = ch.mode AND CAST(x.mass AS DOUBLE) <= ch.thr)"
    alive = " AND ".join(f"b.a{i} IN (SELECT value FROM alive WHERE mode = {i})" for i in range(n))
    step = f"""
WITH cur AS MATERIALIZED (SELECT * FROM {X}PEEL),
st AS MATERIALIZED (SELECT any_value(p) AS p, any_value(M) AS M, {", ".join(f"any_value(c{i}) AS c{i}" for i in range(n))}, any_value(best) AS best,
    any_value(cut_pass) AS cut_pass, any_value(cut_mass) AS cut_mass, any_value(cut_value) AS cut_value, any_value(passes_run) AS passes_run FROM cur),
th AS (SELECT t.mode, CAST(st.M AS DOUBLE) * {dbl(theta)} / CAST({of_mode('t')} AS DOUBLE) AS thr FROM ({modes}) t CROSS JOIN st WHERE {of_mode('t')} > 0),
ca AS (SELECT v.mode, v.mass, v.value, CAST(sum(v.cnt) OVER w AS BIGINT) AS k, CAST(sum(v.cnt * v.mass) OVER w AS BIGINT) AS s
    FROM cur v JOIN th ON v.mode = th.mode WHERE v.rpass IS NULL AND CAST(v.mass AS DOUBLE) <= th.thr
    WINDOW w AS (PARTITION BY v.mode ORDER BY v.mass, v.value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS MATERIALIZED (SELECT ca.*, {density_expr(measure, "(st.M - ca.s)", prod_expr(after), sum_expr(after), n, m0, p0)} AS d FROM ca CROSS JOIN st),
be AS (SELECT mode, d, mass, value FROM d QUALIFY row_number() OVER (PARTITION BY mode ORDER BY d DESC, k) = 1),
picks AS (SELECT mode, max(k) AS k, max(s) AS s FROM d GROUP BY mode),
ch AS MATERIALIZED (SELECT g.mode, g.k, g.s, be.d, be.mass, be.value, th.thr, {pol} AS score
    FROM picks g CROSS JOIN st JOIN be ON g.mode = be.mode JOIN th ON g.mode = th.mode ORDER BY score DESC, g.mode DESC LIMIT 1),
alive AS MATERIALIZED (SELECT x.mode, x.value FROM cur x CROSS JOIN ch WHERE x.rpass IS NULL AND NOT {gone}),
b AS MATERIALIZED (SELECT b.* FROM {src} b WHERE {alive}),
nm AS MATERIALIZED ({value_masses("b", n)})
SELECT st.p + 1, x.mode, x.value, x.cnt, CASE WHEN x.rpass IS NOT NULL OR {gone} THEN x.mass ELSE coalesce(nm.mass, 0) END,
    CASE WHEN x.rpass IS NOT NULL THEN x.rpass WHEN {gone} THEN st.p END, st.M - ch.s,
    {", ".join(f"st.c{i} - CASE WHEN ch.mode = {i} THEN ch.k ELSE 0 END" for i in range(n))},
    CASE WHEN ch.d > st.best THEN ch.d ELSE st.best END, CASE WHEN ch.d > st.best THEN st.p ELSE st.cut_pass END,
    CASE WHEN ch.d > st.best THEN ch.mass ELSE st.cut_mass END, CASE WHEN ch.d > st.best THEN ch.value ELSE st.cut_value END,
    st.passes_run + CASE WHEN st.p = 0 OR st.M > 0 THEN 1 ELSE 0 END, ch.mode, ch.k, ch.s
FROM cur x CROSS JOIN st CROSS JOIN ch LEFT JOIN nm ON x.mode = nm.mode AND x.value = nm.value"""
    return [
        f"{X}SMASS AS (SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS M FROM {src})",
        f"{X}PEEL AS ({base}\nUNION ALL ({step}))",
        f"{X}V AS MATERIALIZED (SELECT * FROM {X}PEEL WHERE p = (SELECT max(p) FROM {X}PEEL))",
        f"{X}S AS MATERIALIZED (SELECT max(p) AS passes, any_value(best) AS best, any_value(cut_pass) AS cut_pass, any_value(cut_mass) AS cut_mass, "
        f"any_value(cut_value) AS cut_value, any_value(passes_run) AS passes_run FROM {X}V)",
    ]


def members_cte(name: str, prefix: str) -> str:
    S = f"{prefix}S"
    return (
        f"{name} AS MATERIALIZED (SELECT v.mode, v.value, v.cnt FROM {prefix}V v WHERE (SELECT cut_pass FROM {S}) IS NULL "
        f"OR v.rpass IS NULL OR v.rpass > (SELECT cut_pass FROM {S}) "
        f"OR (v.rpass = (SELECT cut_pass FROM {S}) AND (v.mass, v.value) > (SELECT (cut_mass, cut_value) FROM {S})))"
    )


def inside(alias: str, members: str, n: int = N3) -> str:
    return " AND ".join(f"{alias}.a{i} IN (SELECT value FROM {members} WHERE mode = {i})" for i in range(n))


def search(rel: str, measure: str, policy: str, theta: float, k: int = 1, n: int = N3, unseen: str = "rows") -> tuple[list[str], list[tuple[str, str, str]]]:
    """CTEs for k blocks: each search runs on what the earlier blocks left.
    Returns (ctes, [(members cte, prefix, relation searched) per block])."""
    ctes = [distinct_cards_cte(rel, n) if unseen == "none" else cards_cte(rel, n), f"ORIGINAL AS (SELECT * FROM {rel})"]
    out = []
    src = rel
    for b in range(1, k + 1):
        prefix = "" if b == 1 else f"K{b}_"
        ctes += peel_ctes(src, measure, policy, theta, n, prefix=prefix, unseen=unseen)
        mem = f"MEMBERS{b}"
        ctes.append(members_cte(mem, prefix))
        out.append((mem, prefix, src))
        if b < k:
            nxt = f"R{b + 1}"
            ctes.append(f"{nxt} AS MATERIALIZED (SELECT r.* FROM {src} r WHERE NOT ({inside('r', mem, n)}))")
            src = nxt
    return ctes, out


def report_select(rel: str, measure: str, blocks: list[tuple[str, str, str]], n: int = N3) -> tuple[list[str], str]:
    full = [f"(SELECT c FROM CARDS WHERE mode = {i})" for i in range(n)]
    p0 = prod_expr(full)
    m0 = "(SELECT M FROM SMASS)"
    dg = 3 if rel == "H" else digits(measure)
    ctes, selects = [], []
    for b, (mem, prefix, src) in enumerate(blocks, start=1):
        last = f"{prefix}S"
        bt = f"BT{b}"
        ctes.append(f"{bt} AS MATERIALIZED (SELECT r.* FROM {rel} r WHERE {inside('r', mem, n)})")
        cards = [f"(SELECT coalesce(sum(cnt), 0) FROM {mem} WHERE mode = {i})" for i in range(n)]
        mass = f"(SELECT coalesce(sum(v), 0) FROM {bt})"
        dens = density_expr(measure, mass, prod_expr(cards), sum_expr(cards), n, m0, p0)
        search_mass = f"(SELECT coalesce(sum(v), 0) FROM {src} r WHERE {inside('r', mem, n)})"
        card_cols = ", ".join(f"CAST({c} AS BIGINT) AS card_{i}" for i, c in enumerate(cards))
        selects.append(
            f"SELECT CAST({b} AS INTEGER) AS block, {card_cols}, CAST({mass} AS BIGINT) AS mass, "
            f"CAST((SELECT count(*) FROM {bt}) AS BIGINT) AS tuples, round({dens}, {dg}) AS density, "
            f"round((SELECT best FROM {last}), {dg}) AS search_density, CAST({search_mass} AS BIGINT) AS search_mass, "
            f"(SELECT passes FROM {last}) AS passes, (SELECT passes_run FROM {last}) AS passes_run"
        )
    return ctes, "\nUNION ALL\n".join(selects)


def find_block_sql(rel: str, measure: str, policy: str, theta: float) -> str:
    ctes, blocks = search(rel, measure, policy, theta, 1)
    return with_rel(rel, *ctes) + f"\nSELECT mode, value FROM {blocks[0][0]}"


def find_blocks_report_sql(rel: str, measure: str, policy: str, theta: float, k: int = 1, columns: str = "*", unseen: str = "rows") -> str:
    ctes, blocks = search(rel, measure, policy, theta, k, unseen=unseen)
    rc, body = report_select(rel, measure, blocks)
    return with_rel(rel, *ctes, *rc) + f"\nSELECT {columns} FROM ({body}) r"


def first_pass_sql(rel: str, measure: str, policy: str, theta: float, select: str) -> str:
    ctes = [cards_cte(rel)]
    pc, _ = first_pass_ctes(rel, measure, policy, theta)
    return with_rel(rel, *ctes, *pc) + "\n" + select


def block_sql(rel: str, measure: str, policy: str, theta: float, select: str) -> str:
    """SQL with the CTE MEMBERS1 (block 1) and BT1 (its tuples) in scope."""
    ctes, blocks = search(rel, measure, policy, theta, 1)
    bt = f"BT1 AS MATERIALIZED (SELECT r.* FROM {rel} r WHERE {inside('r', 'MEMBERS1')})"
    return with_rel(rel, *ctes, bt) + "\n" + select


def best_density_sql(rel: str, measure: str, policy: str, theta: float, k: int) -> str:
    ctes, blocks = search(rel, measure, policy, theta, k)
    rc, body = report_select(rel, measure, blocks)
    return with_rel(rel, *ctes, *rc) + f"\nSELECT max(density) AS best_density FROM ({body}) r"


def blocks_sql(rel: str, measure: str, policy: str, theta: float, k: int, select, unseen: str = "rows") -> str:
    """``select(block number, name of the CTE of its tuples)`` for k blocks, one after the other."""
    ctes, blocks = search(rel, measure, policy, theta, k, unseen=unseen)
    ctes += [f"BT{b} AS MATERIALIZED (SELECT r.* FROM {rel} r WHERE {inside('r', mem)})" for b, (mem, _, _) in enumerate(blocks, start=1)]
    return with_rel(rel, *ctes) + "\n" + "\nUNION ALL\n".join(select(b, f"BT{b}") for b in range(1, k + 1))


def gaps(src: str, cards: str, n: int = N3) -> str:
    """(mode, from, to): the intervals without a value of ``src`` (0 to the largest id)."""
    marks = f"SELECT mode, value FROM ({unpivot(src, n)}) u UNION SELECT mode, -1 FROM {cards} UNION SELECT mode, c FROM {cards}"
    step = f"SELECT mode, lag(value) OVER (PARTITION BY mode ORDER BY value) + 1 AS a, value - 1 AS b FROM ({marks}) m"
    return f'SELECT CAST(mode AS INTEGER) AS mode, a AS "from", b AS "to" FROM ({step}) s WHERE a <= b'


def member_ranges_sql(rel: str, measure: str, policy: str, theta: float, k: int) -> str:
    """Members of k blocks: seen values one by one, never-seen ids as intervals."""
    ctes, blocks = search(rel, measure, policy, theta, k, unseen="count")
    rows = []
    for b, (mem, _, _) in enumerate(blocks, start=1):
        rows.append(f'SELECT CAST({b} AS INTEGER) AS block, mode, value AS "from", value AS "to" FROM {mem} WHERE value >= 0')
        rows.append(f'SELECT CAST({b} AS INTEGER), mode, "from", "to" FROM ({gaps("ORIGINAL", "CARDS")}) g WHERE mode IN (SELECT mode FROM {mem} WHERE value = -1)')
    return with_rel(rel, *ctes) + "\n" + "\nUNION ALL\n".join(rows)


def passes_sql(rel: str, measure: str, policy: str, theta: float, k: int, moved: bool = False, columns: str = "*") -> str:
    """The passes of k searches that have to be run. ``stat_rows`` is what the statistics of a pass
    read: the alive seen values; with a kept histogram the values whose mass has changed
    (at first: all) and the histogram."""
    ctes, blocks = search(rel, measure, policy, theta, k, unseen="count")
    rows = []
    for b, (_, X, _) in enumerate(blocks, start=1):
        alive = "count(*) FILTER (rpass IS NULL AND value >= 0)"
        if moved:
            alive = "count(*) FILTER (rpass IS NULL AND value >= 0 AND (before IS NULL OR before <> mass)) + count(DISTINCT (mode, mass)) FILTER (rpass IS NULL AND value >= 0)"
        ctes.append(
            f"{X}LOG AS (SELECT p, any_value(M) AS M, any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, any_value(chosen) AS chosen, any_value(ck) AS ck, any_value(cs) AS cs, "
            f"{alive} AS r FROM (SELECT *, lag(mass) OVER (PARTITION BY mode, value ORDER BY p) AS before FROM {X}PEEL) x GROUP BY p)"
        )
        rows.append(
            f"SELECT CAST({b} AS INTEGER) AS block, a.p AS pass, n.chosen AS mode, n.ck AS k, n.cs AS s, a.M AS mass_before, a.c0 AS alive_0, a.c1 AS alive_1, a.c2 AS alive_2, "
            f"CAST(a.r AS BIGINT) AS stat_rows FROM {X}LOG a JOIN {X}LOG n ON n.p = a.p + 1 WHERE a.p = 0 OR a.M > 0"
        )
    return with_rel(rel, *ctes) + f"\nSELECT {columns} FROM (" + "\nUNION ALL\n".join(rows) + ") r"
