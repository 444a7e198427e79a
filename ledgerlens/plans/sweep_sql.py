"""DuckDB SQL of the regressions: least squares by sweeping the Gram matrix in long form.

Written apart from the Spark solver, so that the two can be compared. The design is
a table (row, column, value), its Gram matrix a table (i, j, v), and a recursive query
sweeps one column a step, in term order, passing over columns that earlier ones
determine. What remains holds the coefficients, the negative inverse and the
residual sum of squares. Tails of t are finite sums for whole degrees of freedom,
tails of F a power series.
"""

from __future__ import annotations

from dataclasses import dataclass

from ledgerlens.plans.oracle import FULL_INVOICE, LINES, NUMERIC_INVOICE, cmp4, cmp_sig


@dataclass(frozen=True)
class Model:
    """A regression over the SQL table ``source``; ``split`` is the condition of its training rows."""

    source: str
    label: str
    terms: tuple[str, ...]
    factors: tuple[str, ...] = ()
    interactions: tuple[tuple[str, str], ...] = ()
    keys: tuple[str, ...] = ("customer_type",)
    split: str | None = None

    @property
    def numerics(self) -> list[str]:
        return [t for t in self.terms if t not in self.factors]


def split_on(*keys: str) -> str:
    return f"substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8) < 'cccccccc'"


ELIGIBLE = """
elig AS (
  SELECT customer_type, product, rk FROM (
    SELECT customer_type, product, count(*) AS n, row_number() OVER (PARTITION BY customer_type ORDER BY sum(total_price) DESC, product) AS rk
    FROM tlines GROUP BY customer_type, product)
  WHERE rk <= 10 AND n >= 50
)"""
LINE_SPLIT = split_on("order_id", "customer_id", "product", "order_date")
MONTHLY = "(SELECT *, strftime(order_date, '%m') AS month FROM tlines WHERE customer_type = '{}' {})"
IN_ELIGIBLE = "AND (customer_type, product) IN (SELECT (customer_type, product) FROM elig)"


def product_model(ctype: str, split: bool = False) -> Model:
    terms = ("discount", "region", "month") if ctype == "B2B" else ("region", "month")
    return Model(MONTHLY.format(ctype, IN_ELIGIBLE), "quantity", terms, ("region", "month"), (), ("customer_type", "product"), LINE_SPLIT if split else None)


POOLED = Model(MONTHLY.format("B2C", ""), "quantity", ("discount", "product", "region", "month"), ("product", "region", "month"))
INVOICE = Model("inv", "total_price", ("quantity", "discount", "unit_price"), split=split_on("customer_id", "order_date"))
QUARTERLY = "(SELECT *, CAST(quarter(order_date) AS DOUBLE) AS quarter FROM finv)"
INVOICE_RQ = Model(
    QUARTERLY, "total_price", ("quantity", "discount", "unit_price", "region", "quarter"), ("region",), split=split_on("order_id", "customer_id", "order_date", "region")
)
INVOICE_REGION = Model("finv", "total_price", ("quantity", "discount", "unit_price", "region"), ("region",))
COMBINED = Model(
    "finv", "total_price", ("quantity", "discount", "unit_price", "region", "customer_type"), ("region", "customer_type"),
    tuple((x, "customer_type") for x in ("quantity", "discount", "unit_price")), (),
)
WEEKEND = Model(
    """(SELECT *, month(order_date) AS month, CASE WHEN dayofweek(order_date) IN (0, 6) THEN 1.0 ELSE 0.0 END AS is_weekend
        FROM tlines WHERE customer_type = 'B2C' AND (customer_type, product) IN (SELECT (customer_type, product) FROM elig WHERE rk = 1)
          AND discount IS NOT NULL AND NOT isnan(discount))""",
    "quantity", ("unit_price", "region", "month", "is_weekend"), ("region", "month"), (), ("customer_type", "product"), LINE_SPLIT,
)


def fit_ctes(m: Model) -> str:
    """CTEs mf (model rows), tr (training rows), cols, coef (coefficients) and fit (one row a model)."""
    keys = list(m.keys) or ["one"]
    k = ", ".join(keys)
    x = m.numerics
    joined = [*x, *m.factors]

    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)

    def of(a: str) -> str:
        return ", ".join(f"{a}.{c}" for c in keys)

    some = [f"{c} IS NOT NULL AND NOT isnan({c})" for c in [m.label, *x]] + [f"{f} IS NOT NULL" for f in m.factors]
    own = [c for c in m.keys if c not in joined] if m.keys else ["0 AS one"]
    levels = "".join(
        f"\nlv_{f} AS MATERIALIZED (SELECT {k}, lvl, row_number() OVER (PARTITION BY {k} ORDER BY lvl) AS r FROM (SELECT DISTINCT {k}, {f} AS lvl FROM tr)),"
        for f in m.factors
    )
    columns = [f"SELECT {k}, 0 AS o, 0 AS r, '(Intercept)' AS term, 'intercept' AS kind, NULL AS var, NULL AS fac, NULL AS lvl, NULL AS raw FROM gm"]
    entries = [f"SELECT t.rid, {of('t')}, 1 AS j, 1.0 AS v FROM tr t", f"SELECT t.rid, {of('t')}, 0, t.y - gm.gy FROM tr t JOIN gm ON {on('t', 'gm')}"]
    place = 0
    for t in m.terms:
        place += 1
        if t in m.factors:
            columns.append(f"SELECT {k}, {place}, r, '{t}' || CAST(lvl AS VARCHAR), 'factor', NULL, '{t}', CAST(lvl AS VARCHAR), NULL FROM lv_{t} WHERE r > 1")
            entries.append(f"SELECT t.rid, {of('t')}, c.j, 1.0 FROM tr t JOIN cols c ON {on('t', 'c')} AND c.kind = 'factor' AND c.fac = '{t}' AND c.lvl = CAST(t.{t} AS VARCHAR)")
        else:
            columns.append(f"SELECT {k}, {place}, 0, '{t}', 'numeric', '{t}', NULL, NULL, q_{t} FROM gm")
            entries.append(f"SELECT t.rid, {of('t')}, c.j, t.{t} - gm.g_{t} FROM tr t JOIN gm ON {on('t', 'gm')} JOIN cols c ON {on('t', 'c')} AND c.kind = 'numeric' AND c.var = '{t}'")
    for v, f in m.interactions:
        place += 1
        columns.append(f"SELECT {k}, {place}, r, '{v}:{f}' || CAST(lvl AS VARCHAR), 'interaction', '{v}', '{f}', CAST(lvl AS VARCHAR), NULL FROM lv_{f} WHERE r > 1")
        entries.append(
            f"SELECT t.rid, {of('t')}, c.j, t.{v} - gm.g_{v} FROM tr t JOIN gm ON {on('t', 'gm')}"
            f" JOIN cols c ON {on('t', 'c')} AND c.kind = 'interaction' AND c.var = '{v}' AND c.fac = '{f}' AND c.lvl = CAST(t.{f} AS VARCHAR)"
        )
    means = "".join(f", avg({c}) AS g_{c}, sum({c} * {c}) AS q_{c}" for c in x)
    mean_of = " ".join(f"WHEN '{c}' THEN gm.g_{c}" for c in x)
    centre = f"CASE c.var {mean_of} ELSE 0.0 END" if x else "0.0"
    union = "\n  UNION ALL ".join
    return f"""
mf AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, {', '.join([*own, *joined])}, CAST({m.label} AS DOUBLE) AS y, {m.split or 'TRUE'} AS is_train
  FROM {m.source} WHERE {' AND '.join(some)}
),
tr AS MATERIALIZED (SELECT * FROM mf WHERE is_train),
gm AS MATERIALIZED (SELECT {k}, count(*) AS n, avg(y) AS gy{means} FROM tr GROUP BY {k}),{levels}
cols AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY o, r) AS j FROM (
  {union(columns)})),
x AS MATERIALIZED ({union(entries)}),
g AS MATERIALIZED (SELECT {of('a')}, a.j AS i, b.j AS j, fsum(a.v * b.v) AS v FROM x a JOIN x b ON a.rid = b.rid GROUP BY {of('a')}, a.j, b.j),
places AS (SELECT {k}, j FROM cols UNION ALL SELECT {k}, 0 FROM gm),
whole AS MATERIALIZED (
  SELECT {of('a')}, a.j AS i, b.j AS j, coalesce(g.v, 0.0) AS v
  FROM places a JOIN places b ON {on('a', 'b')} LEFT JOIN g ON {on('g', 'a')} AND g.i = a.j AND g.j = b.j
  UNION ALL SELECT {k}, -1, j, 0.0 FROM places
),
diag AS MATERIALIZED (SELECT {of('c')}, c.j, c.kind, c.raw, g.v AS d FROM cols c JOIN g ON {on('g', 'c')} AND g.i = c.j AND g.j = c.j),
swept AS (
  SELECT 1 AS step, {k}, i, j, v FROM whole
  UNION ALL
  SELECT step + 1, {k}, i, j,
    CASE WHEN NOT coalesce(pp > 1e-10 * d AND NOT (kind = 'numeric' AND d <= 1e-14 * raw), FALSE) THEN v
         WHEN i = -1 THEN CASE WHEN j = step THEN 1.0 ELSE v END
         WHEN i = step AND j = step THEN -1.0 / pp
         WHEN i = step OR j = step THEN v / pp
         ELSE v - pr * pc / pp END
  FROM (
    SELECT s.*, diag.d, diag.kind, diag.raw,
      max(CASE WHEN s.i = s.step AND s.j = s.step THEN s.v END) OVER (PARTITION BY {of('s')}) AS pp,
      max(CASE WHEN s.i = s.step THEN s.v END) OVER (PARTITION BY {of('s')}, s.j) AS pr,
      max(CASE WHEN s.j = s.step THEN s.v END) OVER (PARTITION BY {of('s')}, s.i) AS pc
    FROM swept s LEFT JOIN diag ON {on('s', 'diag')} AND diag.j = s.step
    WHERE s.step <= (SELECT max(j) FROM cols)
  )
),
fin AS MATERIALIZED (SELECT * FROM swept WHERE step = (SELECT max(j) + 1 FROM cols)),
kept AS MATERIALIZED (SELECT c.* FROM cols c JOIN fin ON {on('fin', 'c')} AND fin.i = -1 AND fin.j = c.j AND fin.v = 1),
back AS MATERIALIZED (
  SELECT {k}, j AS o, j, 1.0 AS t FROM kept
  UNION ALL SELECT {of('c')}, 1, c.j, -{centre} FROM kept c JOIN gm ON {on('gm', 'c')} WHERE c.kind = 'numeric'
  UNION ALL SELECT {of('c')}, coalesce(f.j, 1), c.j, -{centre} FROM kept c JOIN gm ON {on('gm', 'c')}
    LEFT JOIN kept f ON {on('f', 'c')} AND f.kind = 'factor' AND f.fac = c.fac AND f.lvl = c.lvl WHERE c.kind = 'interaction'
),
est AS (SELECT {of('b')}, b.o AS j, fsum(b.t * fin.v) AS e FROM back b JOIN fin ON {on('fin', 'b')} AND fin.i = b.j AND fin.j = 0 GROUP BY {of('b')}, b.o),
uv AS (
  SELECT {of('a')}, a.o AS j, fsum(-a.t * b.t * fin.v) AS u
  FROM back a JOIN back b ON {on('a', 'b')} AND a.o = b.o JOIN fin ON {on('fin', 'a')} AND fin.i = a.j AND fin.j = b.j GROUP BY {of('a')}, a.o
),
fit AS MATERIALIZED (
  SELECT {of('gm')}, gm.n, CAST((SELECT count(*) FROM kept WHERE {on('kept', 'gm')}) AS INTEGER) AS rank, fin.v AS rss, g.v AS tss
  FROM gm JOIN fin ON {on('fin', 'gm')} AND fin.i = 0 AND fin.j = 0 JOIN g ON {on('g', 'gm')} AND g.i = 0 AND g.j = 0
),
coef AS MATERIALIZED (
  SELECT c.*, est.e + CASE WHEN c.j = 1 THEN gm.gy ELSE 0.0 END AS estimate, sqrt(rss / (fit.n - rank) * u) AS std_error, fit.n - rank AS df, est.e IS NULL AS aliased
  FROM cols c JOIN fit ON {on('fit', 'c')} JOIN gm ON {on('gm', 'c')} LEFT JOIN est ON {on('est', 'c')} AND est.j = c.j LEFT JOIN uv ON {on('uv', 'c')} AND uv.j = c.j
)"""


def t_tail(t: str, df: str) -> str:
    """P(|T| > |t|) for whole degrees of freedom, by finite sums of powers of the cosine."""
    cos2 = f"({df} / ({df} + {t} * {t}))"
    sin, theta = f"(abs({t}) / sqrt({df} + {t} * {t}))", f"atan(abs({t}) / sqrt({df}))"
    even = f"{sin} * list_sum(list_transform(range(0, {df} // 2), lambda z: exp(lgamma(z + 0.5) - lgamma(z + 1.0) - 0.5 * ln(pi()) + z * ln{cos2})))"
    odd = f"list_sum(list_transform(range(0, ({df} - 1) // 2), lambda z: exp(lgamma(z + 1.0) + lgamma(1.5) - lgamma(z + 1.5) + z * ln{cos2})))"
    return f"greatest(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE 2 / pi() * ({theta} + {sin} * sqrt{cos2} * coalesce({odd}, 0.0)) END, 0.0)"


def beta_series(a: str, b: str, x: str) -> str:
    """The incomplete beta ratio I_x(a, b) by its power series in x."""
    first = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a}"
    return f"{first} * list_sum(list_transform(range(0, 20000), lambda z: exp(lgamma({a} + {b} + z) - lgamma({a} + {b}) + lgamma({a} + 1) - lgamma({a} + 1 + z) + z * ln({x}))))"


def coefficients_sql(m: Model, ctes: str) -> str:
    """The coefficient table, doubles cut for comparison."""
    t = "(estimate / nullif(std_error, 0))"
    keys = "".join(f"{c}, " for c in m.keys)
    return f"""WITH RECURSIVE {ctes},{fit_ctes(m)},
tested AS (SELECT *, {t} AS t FROM coef)
SELECT {keys}CAST(j AS INTEGER) AS term_index, term, {cmp4('estimate')} AS estimate, {cmp4('std_error')} AS std_error, {cmp4('t')} AS t_value,
       {cmp4(f"CASE WHEN t IS NOT NULL THEN {t_tail('t', 'df')} END")} AS p_value, aliased
FROM tested"""


STATS = """
stats AS (
  SELECT *, n - rank AS df, rank - 1 AS df1, sqrt(rss / (n - rank)) AS sigma, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1.0) / (n - rank) AS adj_r2,
         ((tss - rss) / (rank - 1)) / (rss / (n - rank)) AS f
  FROM fit
)"""


def fit_stats_sql(m: Model, ctes: str) -> str:
    """The fit summary, doubles cut for comparison."""
    low, high = beta_series("(df / 2.0)", "(df1 / 2.0)", "(df / (df + df1 * f))"), beta_series("(df1 / 2.0)", "(df / 2.0)", "(df1 * f / (df + df1 * f))")
    p = f"CASE WHEN df / (df + df1 * f) < (df / 2.0 + 1) / ((df + df1) / 2.0 + 2) THEN {low} ELSE 1 - {high} END"
    c = {x: cmp4(x) for x in ("sigma", "r2", "adj_r2", "rss", "tss")}
    return f"""WITH RECURSIVE {ctes},{fit_ctes(m)},{STATS}
SELECT {', '.join(m.keys)}, n, rank, df AS df_resid, {c['sigma']} AS sigma, {c['r2']} AS r2, {c['adj_r2']} AS adj_r2, {cmp4('f')} AS f_stat,
       CAST(df1 AS INTEGER) AS f_df1, df AS f_df2, {cmp4(p)} AS f_p_value, {c['rss']} AS rss, {c['tss']} AS tss
FROM stats"""


def fit_all_sql(name: str, m: Model, ctes: str) -> str:
    group = m.keys[0] if m.keys else "'all'"
    doubles = ", ".join(f"{cmp_sig(e, 6)} AS {c}" for c, e in {"sigma": "sigma", "r2": "r2", "adj_r2": "adj_r2", "f_stat": "f"}.items())
    return f"""WITH RECURSIVE {ctes},{fit_ctes(m)},{STATS}
SELECT '{name}' AS model, {group} AS customer_type, n, rank, df AS df_resid, {doubles}, CAST(df1 AS INTEGER) AS f_df1, df AS f_df2 FROM stats"""


def held_out_ctes(m: Model) -> str:
    """CTE held: hold-out measures of each model; a row with a level that training lacks has no prediction."""
    k = ", ".join(m.keys)

    def on(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{c} = {b}.{c}" for c in m.keys)

    effects = "".join(
        f"\ne_{f} AS (SELECT {', '.join(f'l.{c}' for c in m.keys)}, l.lvl, coalesce(c.estimate, 0.0) AS e FROM lv_{f} l"
        f" LEFT JOIN coef c ON {on('c', 'l')} AND c.kind = 'factor' AND c.fac = '{f}' AND c.lvl = CAST(l.lvl AS VARCHAR)),"
        for f in m.factors
    )
    slopes = ", ".join(["max(CASE WHEN kind = 'intercept' THEN estimate END) AS b0", *[f"coalesce(max(CASE WHEN kind = 'numeric' AND var = '{c}' THEN estimate END), 0.0) AS b_{c}" for c in m.numerics]])
    p = " + ".join(["b.b0", *[f"b.b_{c} * t.{c}" for c in m.numerics], *[f"e_{f}.e" for f in m.factors]])
    joins = " ".join(f"LEFT JOIN e_{f} ON {on(f'e_{f}', 't')} AND e_{f}.lvl = t.{f}" for f in m.factors)
    return f"""{effects}
slopes AS (SELECT {k}, {slopes} FROM coef GROUP BY {k}),
scored AS (SELECT {', '.join(f't.{c}' for c in m.keys)}, t.y, {p} AS p FROM mf t LEFT JOIN slopes b ON {on('b', 't')} {joins} WHERE NOT t.is_train),
held AS (
  SELECT {k}, count(*) AS n_test, CAST(count(*) - count(p) AS BIGINT) AS n_unscored, sqrt(avg((y - p) * (y - p))) AS rmse,
         1 - sum((y - p) * (y - p)) / nullif(count(p) * var_pop(CASE WHEN p IS NOT NULL THEN y END), 0) AS test_r2,
         CASE WHEN var_pop(p) > 0 THEN corr(CASE WHEN p IS NOT NULL THEN y END, p) ** 2 END AS r2_corr
  FROM scored GROUP BY {k}
)"""


def model_metrics_sql(ctype: str) -> str:
    m = product_model(ctype, split=True)
    return f"""WITH RECURSIVE {LINES},{ELIGIBLE},{fit_ctes(m)},{STATS},{held_out_ctes(m)}
SELECT s.customer_type, s.product, round(r2, 3) + 0.0 AS train_r2, round(adj_r2, 3) + 0.0 AS train_adj_r2, round(test_r2, 3) + 0.0 AS test_r2, round(rmse, 3) AS rmse_test,
       s.n AS n_train, coalesce(n_test, 0) AS n_test, coalesce(n_unscored, 0) AS n_unscored
FROM stats s LEFT JOIN held h ON h.customer_type = s.customer_type AND h.product = s.product"""


def stratified_metrics_sql(split_rows: str) -> str:
    """Hold-out measures of the invoice model; ``split_rows`` is SQL of the stratified split."""
    m = Model("(SELECT inv.*, s.is_train AS chosen FROM inv JOIN strata s USING (customer_type, customer_id, order_date))", INVOICE.label, INVOICE.terms, split="chosen")
    doubles = ", ".join(f"{cmp_sig(e, 6)} AS {c}" for c, e in {"rmse_test": "rmse", "r2_corr": "r2_corr", "test_r2": "test_r2"}.items())
    return f"""WITH RECURSIVE {NUMERIC_INVOICE}, strata AS MATERIALIZED ({split_rows}),{fit_ctes(m)},{held_out_ctes(m)}
SELECT customer_type, {doubles}, n_test, n_unscored FROM held"""


def union_all(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def oracle(stratified_rows: str) -> dict[str, str]:
    lines = f"{LINES},{ELIGIBLE}"
    b2b, b2c = product_model("B2B"), product_model("B2C")
    out = {
        "ols_product_b2b": coefficients_sql(b2b, lines),
        "ols_product_b2c": coefficients_sql(b2c, lines),
        "ols_pooled_b2c": coefficients_sql(POOLED, LINES),
        "ols_invoice": coefficients_sql(INVOICE, NUMERIC_INVOICE),
        "ols_invoice_rq": coefficients_sql(INVOICE_RQ, FULL_INVOICE),
        "ols_invoice_region": coefficients_sql(INVOICE_REGION, FULL_INVOICE),
        "ols_combined": coefficients_sql(COMBINED, FULL_INVOICE),
        "ols_weekend": coefficients_sql(WEEKEND, lines),
        "ols_fit": union_all(fit_stats_sql(b2b, lines), fit_stats_sql(b2c, lines)),
        "model_metrics": union_all(model_metrics_sql("B2B"), model_metrics_sql("B2C")),
        "invoice_metrics_stratified": stratified_metrics_sql(stratified_rows),
        "weekend_metrics": f"""WITH RECURSIVE {lines},{fit_ctes(WEEKEND)},{held_out_ctes(WEEKEND)}
SELECT customer_type, product, round(rmse, 2) AS rmse, round(test_r2, 4) + 0.0 AS r2, n_test FROM held""",
        "ols_fit_all": union_all(
            fit_all_sql("pooled_b2c", POOLED, LINES), fit_all_sql("invoice", INVOICE, NUMERIC_INVOICE), fit_all_sql("invoice_region_quarter", INVOICE_RQ, FULL_INVOICE),
            fit_all_sql("invoice_region", INVOICE_REGION, FULL_INVOICE), fit_all_sql("combined", COMBINED, FULL_INVOICE), fit_all_sql("weekend", WEEKEND, lines),
        ),
    }
    out["ols_coef"] = union_all(out["ols_product_b2b"], out["ols_product_b2c"])
    return out
