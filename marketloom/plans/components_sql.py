"""Principal components in SQL for DuckDB, by squaring covariance matrices until only the first component is left."""

from __future__ import annotations

from ..operators.expanding import TIED


def scores_sql(name: str, source: str, columns: list[str], window: int | None, first: int, q: float = 0.98) -> str:
    """Common tables of a group: {name}_cov (g, row_id, i, j, v), what each row's matrix is, and {name}_dev (g, row_id, i, d, n), its clipped value less the mean, and how many columns count.

    source has row_id and the columns.
    """
    k = range(len(columns))
    frame = f"ORDER BY row_id ROWS BETWEEN {'UNBOUNDED' if window is None else window} PRECEDING AND 1 PRECEDING"
    since = "" if window is None else f" AND w.row_id >= b.row_id - {window}"
    bounds = ", ".join(f"quantile_cont(x{i}, {round(1 - q, 10)}) OVER f AS l{i}, quantile_cont(x{i}, {q}) OVER f AS h{i}" for i in k)
    clip = lambda x, i: f"CASE WHEN {x} IS NULL OR l{i} IS NULL THEN 0.0 WHEN {x} < l{i} THEN l{i} WHEN {x} > h{i} THEN h{i} ELSE {x} END"
    sums = ", ".join([f"avg(y{i}) AS m{i}" for i in k] + [f"covar_pop(y{i}, y{j}) AS c{i}_{j}" for i in k for j in k if i <= j])
    cells = [(i, j) for i in k for j in k]
    unnest = lambda xs: "unnest([" + ", ".join(map(str, xs)) + "])"
    return (
        f"{name}_w AS MATERIALIZED (SELECT row_id, {', '.join(f'{c} AS x{i}' for i, c in enumerate(columns))} FROM {source}), "
        f"{name}_b AS MATERIALIZED (SELECT row_id, {', '.join(f'x{i} AS t{i}' for i in k)}, {bounds} FROM {name}_w WINDOW f AS ({frame})), "
        f"{name}_s AS MATERIALIZED (SELECT row_id, {sums} FROM (SELECT b.row_id, {', '.join(f'{clip(f"x{i}", i)} AS y{i}' for i in k)} FROM {name}_b b JOIN {name}_w w ON w.row_id < b.row_id{since} WHERE b.row_id >= {first}) GROUP BY row_id), "
        f"{name}_cov AS (SELECT '{name}' AS g, row_id, {unnest(i for i, _ in cells)} AS i, {unnest(j for _, j in cells)} AS j, {unnest(f'c{min(c)}_{max(c)}' for c in cells)} AS v FROM {name}_s), "
        f"{name}_dev AS (SELECT '{name}' AS g, row_id, {unnest(k)} AS i, {unnest(f'{clip(f"t{i}", i)} - m{i}' for i in k)} AS d, {' + '.join(f'(l{i} IS NOT NULL)::INT' for i in k)} AS n FROM {name}_b JOIN {name}_s USING (row_id)), "
    )


def components_sql(names: list[str], squarings: int, least: int = 5) -> str:
    """Common tables up to pc (g, row_id, pc1), where too few columns give NULL; the largest loading is positive, of equal ones the first.

    A matrix is divided by its trace at each squaring. Where its two largest values differ by a part in 2 ** squarings
    or less, the component is not told apart.
    """
    out = "p0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM {n}_cov" for n in names) + "), "
    for s in range(squarings):
        out += (
            f"q{s} AS MATERIALIZED (SELECT a.g, a.row_id, a.i, b.j, sum(a.v * b.v) AS v FROM p{s} a JOIN p{s} b ON a.g = b.g AND a.row_id = b.row_id AND a.j = b.i GROUP BY ALL), "
            f"p{s + 1} AS MATERIALIZED (SELECT g, row_id, i, j, v / nullif(t, 0) AS v FROM q{s} JOIN (SELECT g, row_id, sum(v) AS t FROM q{s} WHERE i = j GROUP BY ALL) USING (g, row_id)), "
        )
    return (
        out + f"tops AS (SELECT g, row_id, i, v, max(v) OVER (PARTITION BY g, row_id) AS most FROM p{squarings} WHERE i = j), "
        f"top AS (SELECT g, row_id, min(i) AS j, arg_min(v, i) AS v FROM tops WHERE v >= most * (1 - 2.0 / {TIED}) GROUP BY ALL), "
        f"loads AS (SELECT p.g, p.row_id, p.i, p.v / sqrt(top.v) AS load FROM p{squarings} p JOIN top ON p.g = top.g AND p.row_id = top.row_id AND p.j = top.j), "
        "devs AS (" + " UNION ALL ".join(f"SELECT * FROM {n}_dev" for n in names) + f"), pc AS (SELECT g, row_id, CASE WHEN any_value(n) >= {least} THEN sum(d * load) END AS pc1 FROM devs JOIN loads USING (g, row_id, i) GROUP BY ALL)"
    )
