"""Pieces of DuckDB SQL for the registered queries."""

from __future__ import annotations

K, TH, MAX_SZ, STEP = 15, 0.3, 50, 0.05
MEMBERS = {"lo": (1, 48), "mid": (9, 56), "hi": (17, 64)}

_DOT = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))"
_COS = "list_cosine_similarity(a.e, b.e)"
DISTANCE = {
    "cosine": f"1 - {_COS}",
    "l1": "list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2])))",
    "l2": "list_distance(a.e, b.e)",
    "linf": "list_max(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2])))",
    "angular": f"acos(greatest(-1, least(1, {_COS})))",
    "hamming": "list_sum(list_transform(list_zip(a.e, b.e), lambda z: bit_count(xor(z[1], z[2]))))::DOUBLE",
}
EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
CODES = "codes AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 64)::BIGINT + 64) AS e FROM embeddings)"


def knn(name: str = "knn", source: str = "emb", metric: str = "cosine", k: int = K) -> str:
    d = DISTANCE[metric]
    return (
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT id, nbr, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank"
        f" FROM (SELECT a.id, b.id AS nbr, {d} AS dist FROM {source} a, {source} b)) WHERE rank <= {k})"
    )


def members() -> str:
    parts = [EMB]
    for m, (first, last) in MEMBERS.items():
        parts += [f"emb_{m} AS (SELECT id, e[{first}:{last}] AS e FROM emb)", knn(f"knn_{m}", f"emb_{m}")]
    return ", ".join(parts)


def canonical(source: str) -> str:
    return f"SELECT least(id, nbr) AS a, greatest(id, nbr) AS b, arg_min(1 - dist, id * 1000 + rank) AS score FROM {source} GROUP BY 1, 2"


NEAR = f"near AS (SELECT * FROM knn WHERE 1 - dist > {TH} AND id <> nbr)"
PAIRS = f"{EMB}, {knn()}, {NEAR}, pairs AS MATERIALIZED ({canonical('near')})"
VOTES = (
    f"{members()}, {knn()}, {NEAR}, cast_votes AS (" + " UNION ALL ".join(f"SELECT id, nbr FROM knn_{m}" for m in MEMBERS)
    + "), votes AS (SELECT n.id, n.rank, n.nbr, n.dist, count(v.id) AS votes FROM near n LEFT JOIN cast_votes v ON n.id = v.id AND n.nbr = v.nbr GROUP BY ALL)"
)
ALL = f"{EMB}, {knn()}, allp AS (SELECT DISTINCT least(id, nbr) AS a, greatest(id, nbr) AS b FROM knn WHERE id <> nbr)"


def components(edges: str, name: str = "comp", nodes: str | None = None) -> str:
    """CTEs that give ``name``(id, comp) over the table ``edges``(a, b); add to WITH RECURSIVE."""
    nodes = nodes or f"(SELECT a AS v FROM {edges} UNION SELECT b FROM {edges})"
    return (
        f"sym_{name} AS MATERIALIZED (SELECT a AS u, b AS v FROM {edges} UNION SELECT b, a FROM {edges}), "
        f"walk_{name}(root, v) AS (SELECT v, v FROM {nodes} UNION SELECT w.root, s.v FROM walk_{name} w JOIN sym_{name} s ON w.v = s.u WHERE w.root < s.v), "
        f"{name} AS MATERIALIZED (SELECT v AS id, min(root) AS comp FROM walk_{name} GROUP BY v)"
    )


def propagation(pairs: str, max_iter: int, max_sz: int = MAX_SZ, step: float = STEP) -> str:
    """CTEs that give prop(id, comp) after a round with all edges and ``max_iter`` with a threshold, what is left merged."""
    rounds = max_iter + 1
    parts = [f"t0 AS (SELECT min(score) AS t FROM {pairs})", f"d0 AS MATERIALIZED (SELECT a, b, score FROM {pairs})", "n0 AS MATERIALIZED (SELECT a AS v FROM d0 UNION SELECT b FROM d0)"]
    for r in range(rounds):
        parts.append(components(f"d{r}", f"c{r}", f"n{r}"))
        parts.append(f"z{r} AS MATERIALIZED (SELECT id, comp, count(*) OVER (PARTITION BY comp) AS size FROM c{r})")
        parts.append(f"n{r + 1} AS MATERIALIZED (SELECT id AS v FROM z{r} WHERE size > {max_sz})")
        parts.append(f"t{r + 1} AS (SELECT t + (1 - t) * {step} AS t FROM t{r})")
        parts.append(f"d{r + 1} AS MATERIALIZED (SELECT a, b, score FROM d{r}, t{r + 1} WHERE score >= t AND a IN (SELECT v FROM n{r + 1}) AND b IN (SELECT v FROM n{r + 1}))")
    done = " UNION ALL ".join(f"SELECT id, comp FROM z{r} WHERE size <= {max_sz}" for r in range(rounds))
    parts.append(f"prop AS MATERIALIZED ({done} UNION ALL SELECT v, (SELECT min(v) FROM n{rounds}) FROM n{rounds})")
    return ", ".join(parts)


LABELS = (
    "numbered AS (SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM prop), "
    "lab AS MATERIALIZED (SELECT e.id, coalesce(n.label, -1)::INTEGER AS label FROM emb e LEFT JOIN numbered n ON e.id = n.id)"
)
CLUSTERED = f"{PAIRS}, {propagation('pairs', 5)}, {LABELS}"
SINGLES = "singles AS (SELECT id, CASE WHEN label = -1 THEN (SELECT max(label) + 1 FROM lab) + row_number() OVER (PARTITION BY label = -1 ORDER BY id) - 1 ELSE label END::INTEGER AS label FROM lab)"


def fscore(pred: str) -> str:
    """Pairwise scores of the table ``pred``(id, label) against the true classes."""
    return (
        f"both_ AS (SELECT e.label AS y, p.label AS c FROM emb e JOIN {pred} p ON e.id = p.id), "
        "sums AS (SELECT (SELECT coalesce(sum(n * n - n), 0) FROM (SELECT count(*) AS n FROM both_ GROUP BY y, c))::BIGINT AS tk, "
        "(SELECT coalesce(sum(n * n - n), 0) FROM (SELECT count(*) AS n FROM both_ GROUP BY c))::BIGINT AS pk, "
        "(SELECT coalesce(sum(n * n - n), 0) FROM (SELECT count(*) AS n FROM both_ GROUP BY y))::BIGINT AS qk)"
        " SELECT tk, pk, qk, round(100.0 * tk / nullif(pk, 0), 6) AS prec, round(100.0 * tk / nullif(qk, 0), 6) AS recall,"
        " round(2 * (100.0 * tk / nullif(pk, 0)) * (100.0 * tk / nullif(qk, 0)) / nullif(100.0 * tk / nullif(pk, 0) + 100.0 * tk / nullif(qk, 0), 0), 6) AS fscore FROM sums"
    )


def dbscan(edges: str, least: int) -> str:
    """CTEs over directed ``edges``(id, nbr) with self that give dens(id, comp, core)."""
    return (
        f"core AS MATERIALIZED (SELECT id FROM {edges} GROUP BY id HAVING count(*) >= {least}), "
        f"inside AS MATERIALIZED (SELECT id AS a, nbr AS b FROM {edges} WHERE id IN (SELECT id FROM core) AND nbr IN (SELECT id FROM core)), "
        f"{components('inside', 'cc')}, "
        f"border AS (SELECT g.id, min(cc.comp) AS comp FROM {edges} g JOIN cc ON g.nbr = cc.id WHERE g.id NOT IN (SELECT id FROM core) GROUP BY g.id), "
        "dens AS (SELECT e.id, coalesce(cc.comp, border.comp) AS comp, cc.id IS NOT NULL AS core FROM emb e LEFT JOIN cc ON e.id = cc.id LEFT JOIN border ON e.id = border.id)"
    )


def soft(pairs: str, depth: int = 5, decay: float = 0.6, max_sz: int = MAX_SZ) -> str:
    """CTEs after ``propagation`` that give soft(id, label, weight): labels carried level by level from oversized first-round components."""
    parts = [
        f"links AS MATERIALIZED (SELECT a AS u, b AS v, score FROM {pairs} UNION ALL SELECT b, a, score FROM {pairs})",
        f"l0 AS MATERIALIZED (SELECT p.id AS root, p.comp AS label, p.id, 1::DOUBLE AS value FROM prop p JOIN z0 ON p.id = z0.id WHERE z0.size > {max_sz})",
        "s0 AS (SELECT root, id FROM l0)",
    ]
    for i in range(1, depth + 1):
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT * FROM (SELECT l.root, l.label, k.v AS id, max(l.value * k.score * {decay}::DOUBLE) AS value FROM l{i - 1} l JOIN links k ON l.id = k.u GROUP BY l.root, l.label, k.v) t"
            f" WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} s WHERE s.root = t.root AND s.id = t.id))"
        )
        parts.append(f"s{i} AS MATERIALIZED (SELECT root, id FROM s{i - 1} UNION ALL SELECT root, id FROM l{i})")
    every = " UNION ALL ".join(["SELECT id, comp AS label, 1::DOUBLE AS value FROM prop", *(f"SELECT id, label, value FROM l{i}" for i in range(1, depth + 1))])
    parts.append(f"raw AS MATERIALIZED (SELECT id, label, sum(value) AS weight FROM ({every}) GROUP BY id, label)")
    parts.append("soft AS (SELECT id, label, weight / sum(weight) OVER (PARTITION BY id) AS weight FROM raw)")
    return ", ".join(parts)


def average_linkage(edges: str, clusters: int) -> str:
    """CTEs over ``edges``(u, v, t) of a graph on emb that give linked(id, comp): mean edge weights, nearest pairs of both ends merged round by round; for WITH RECURSIVE."""
    ends = "SELECT n, u AS node, u, v, t / c AS w FROM {0} UNION ALL SELECT n, v, u, v, t / c FROM {0}"
    best = "SELECT n, node, arg_min((u, v), (w, u, v)) AS e FROM (" + ends + ") GROUP BY n, node"
    mutual = "SELECT n, e[1] AS a, e[2] AS b FROM (" + best + ") GROUP BY n, e HAVING count(*) = 2"
    return (
        f"step(n, u, v, t, c) AS (SELECT 0, u, v, t, 1::DOUBLE FROM {edges} UNION ALL SELECT n + 1, least(x, y), greatest(x, y), sum(t), sum(c) FROM ("
        "SELECT s.n, coalesce(p.a, s.u) AS x, coalesce(q.a, s.v) AS y, s.t, s.c FROM step s"
        f" LEFT JOIN ({mutual.format('step')}) p ON s.u = p.b LEFT JOIN ({mutual.format('step')}) q ON s.v = q.b) WHERE x <> y GROUP BY n, least(x, y), greatest(x, y)), "
        f"merges AS MATERIALIZED (SELECT m.n, m.a, m.b, s.t / s.c AS w FROM ({mutual.format('step')}) m JOIN step s ON s.n = m.n AND s.u = m.a AND s.v = m.b), "
        f"kept AS MATERIALIZED (SELECT a, b FROM merges QUALIFY row_number() OVER (ORDER BY w DESC, n DESC, a DESC, b DESC) > {clusters} - ((SELECT count(*) FROM emb) - (SELECT count(*) FROM merges))), "
        + components("kept", "linked", "(SELECT id AS v FROM emb)")
    )
