"""Tables with a class: profile, preparation, learners, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkite.functions import missing_token
from labelkite.operators import linear, mixed_bayes, prepare, rows, score, sketches, tree
from labelkite.plans import inputs as i
from labelkite.plans.registry import Registry
from labelkite.shared import fresh_path, written
from labelkite.sources import models

registry = Registry()
query = registry.query

NUMERIC = ["o_totalprice", "c_acctbal"]
NOMINAL = ["c_mktsegment", "o_orderpriority", "n_name"]
TARGET = "o_orderstatus"
UNKNOWN = "4-NOT SPECIFIED"


def classed(spark, sf, *more):
    return i.order_table(spark, sf).select(*more, *NUMERIC, *NOMINAL, TARGET)


@query(
    "column_profile",
    f"""WITH {i.ORDER_TABLE},
n AS (
  {' UNION ALL '.join(
      f"SELECT '{c}' AS name, 'double' AS type, min({c}) AS lower, max({c}) AS upper, "
      f"NULL::BIGINT AS n_values, count(*) - count({c}) AS missing FROM t" for c in NUMERIC)}),
s AS (
  {' UNION ALL '.join(
      f"SELECT '{c}' AS name, 'string' AS type, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, "
      f"count(DISTINCT {c}) AS n_values, count(*) - count({c}) AS missing FROM t" for c in [*NOMINAL, TARGET])})
SELECT * FROM n UNION ALL SELECT * FROM s""",
)
def column_profile(spark, sf):
    return rows.profile(classed(spark, sf), NUMERIC, [*NOMINAL, TARGET])


@query(
    "column_values",
    f"""WITH {i.ORDER_TABLE} {' UNION ALL '.join(
        f"SELECT '{c}' AS name, {c} AS value, count(*) AS n FROM t GROUP BY ALL" for c in [*NOMINAL, TARGET])}
UNION ALL SELECT 'c_name', c_name, count(*) FROM t GROUP BY ALL""",
)
def column_values(spark, sf):
    """The values of each column, one of them with a value for nearly every row."""
    return rows.column_values(classed(spark, sf, "c_name"), [*NOMINAL, TARGET, "c_name"])


@query(
    "column_sketches",
    f"""WITH {i.ORDER_TABLE} {' UNION ALL '.join(
        f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, "
        + (f"min({c})" if c in NUMERIC else "NULL::DOUBLE") + " AS lower, " + (f"max({c})" if c in NUMERIC else "NULL::DOUBLE")
        + " AS upper, true AS values_within, " + ("true" if c in NUMERIC else "NULL::BOOLEAN") + " AS median_within FROM t"
        for c in [*NUMERIC, *NOMINAL, TARGET])}""",
)
def column_sketches(spark, sf):
    """Sketches of four batches, stored and united, held against exact counts: are they within their error?"""
    orders = classed(spark, sf, "o_orderkey")
    columns = [*NOMINAL, TARGET]
    batches = [orders.where(F.pmod("o_orderkey", F.lit(4)) == b) for b in range(4)]
    stored = [written(sketches.column_sketches(b, NUMERIC, columns), "sketches") for b in batches]
    found = sketches.estimates(sketches.united(stored), [0.5])
    exact = rows.value_counts(orders, [*NUMERIC, *columns]).groupBy("name").agg(F.count("value").alias("values"))
    below = orders.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in NUMERIC])))
    medians = found.where("at is not null").select("name", F.col("at")[0].alias("median"))
    ranks = below.join(F.broadcast(medians), "name").groupBy("name").agg(
        F.avg((F.col("x") < F.col("median")).cast("double")).alias("low"), F.avg((F.col("x") <= F.col("median")).cast("double")).alias("high")
    )
    both = found.join(exact, "name").join(ranks, "name", "left")
    near = F.abs(F.col("n_values") - F.col("values")) <= F.greatest(0.03 * F.col("values"), F.lit(0.5))
    middle = (F.col("low") <= 0.52) & (F.col("high") >= 0.48)
    return both.select("name", "n", "missing", "lower", "upper", near.alias("values_within"), middle.alias("median_within"))


@query("keep_columns", f"WITH {i.ORDER_TABLE} SELECT o_orderkey, c_name FROM t")
def keep_columns(spark, sf):
    """The order table without the columns that the learners read."""
    table = classed(spark, sf, "o_orderkey", "c_name")
    return rows.keep_columns(table, table.columns, [*NUMERIC, *NOMINAL, TARGET])


@query(
    "missing_token",
    f"""SELECT o_orderkey, nullif(o_orderpriority, '{UNKNOWN}') AS as_missing,
  CASE WHEN o_orderpriority = '{UNKNOWN}' THEN '' ELSE o_orderpriority END AS as_empty FROM orders""",
)
def missing_token_query(spark, sf):
    priority = F.col("o_orderpriority")
    return i.table(spark, sf, "orders").select(
        "o_orderkey",
        missing_token(priority, UNKNOWN).alias("as_missing"),
        missing_token(priority, UNKNOWN, "").alias("as_empty"),
    )


# Missing cells. The tables have none, so some are made by the order key; every row stays.

RULES = [
    (["o_totalprice"], ("none",)),
    (["o_totalprice", "c_acctbal"], ("mean",)),
    (["o_orderpriority"], ("fixed", "other")),
    (["c_mktsegment"], ("most_frequent",)),
]
TYPE_DEFAULTS = {"int": ("fixed", 0), "string": ("fixed", "other")}

GAPS = f"""gaps AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 5 <> 0 THEN c_acctbal END AS c_acctbal,
    CASE WHEN o_orderkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment,
    nullif(o_orderpriority, '{UNKNOWN}') AS o_orderpriority,
    CASE WHEN o_orderkey % 11 <> 0 THEN n_name END AS n_name,
    {i.unit_sql('o_orderkey')} < 0.6 AS train
  FROM t)"""


def gaps(spark, sf):
    key = F.col("o_orderkey")
    return i.order_table(spark, sf).select(
        "o_orderkey",
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        missing_token(F.col("o_orderpriority"), UNKNOWN).alias("o_orderpriority"),
        F.when(key % 11 != 0, F.col("n_name")).alias("n_name"),
    )


def rules(df):
    columns = {c: t for c, t in df.dtypes if c != "o_orderkey"}
    return prepare.resolve_rules(RULES, columns, TYPE_DEFAULTS)


def filled_sql(fit_where: str, apply_where: str) -> str:
    return f"""WITH {i.ORDER_TABLE}, {GAPS},
fit AS (SELECT * FROM gaps WHERE {fit_where}),
m AS (SELECT avg(o_totalprice) AS price, avg(c_acctbal) AS balance FROM fit),
f AS (
  SELECT c_mktsegment AS segment FROM fit WHERE c_mktsegment IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, round(coalesce(o_totalprice, price), 6) AS o_totalprice,
  round(coalesce(c_acctbal, balance), 6) AS c_acctbal, coalesce(c_mktsegment, segment) AS c_mktsegment,
  coalesce(o_orderpriority, 'other') AS o_orderpriority, coalesce(n_name, 'other') AS n_name
FROM gaps, m, f WHERE {apply_where}"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in NUMERIC})


@query("impute", filled_sql("true", "true"))
def impute(spark, sf):
    """Fitting and filling read one stored table: the joins run once."""
    df = written(gaps(spark, sf), "gaps")
    return rounded(prepare.impute(df, rules(df)))


@query("impute_apply", filled_sql("train", "NOT train"))
def impute_apply(spark, sf):
    train, rest = rows.hash_split(gaps(spark, sf), i.WEIGHTS, ["o_orderkey"], i.SEED)
    root = fresh_path(spark, "models")
    models.write_model(prepare.impute_fit(train, rules(train)), root, "orders")
    return rounded(models.load_impute(spark, root, "orders").apply(rest))


# The nominal values of the given tables, which the SQL has to name.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", UNKNOWN, "5-LOW"]
STATUSES = ["F", "O", "P"]


@query(
    "one_hot",
    f"""WITH {i.ORDER_TABLE} SELECT o_orderkey, c_mktsegment, o_orderpriority,
  {', '.join(f"CAST(c_mktsegment = '{v}' AS INT) AS " + f'"{v}_c_mktsegment"' for v in SEGMENTS)},
  {', '.join(f"CAST(o_orderpriority = '{v}' AS INT) AS " + f'"{v}_o_orderpriority"' for v in PRIORITIES)}
FROM t""",
)
def one_hot(spark, sf):
    df = i.order_table(spark, sf).select("o_orderkey", "c_mktsegment", "o_orderpriority")
    return prepare.one_hot(df, ["c_mktsegment", "o_orderpriority"])


def scaled_sql(fit_where: str, apply_where: str) -> str:
    scaled = ", ".join(
        f"round(-1e0 + ({c} - lo_{c}) / (hi_{c} - lo_{c}) * 2e0, 6) AS {c}" for c in NUMERIC
    )
    bounds = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMERIC)
    return f"""WITH {i.ORDER_TABLE}, p AS (SELECT *, {i.unit_sql('o_orderkey')} < 0.6 AS train FROM t),
b AS (SELECT {bounds} FROM p WHERE {fit_where})
SELECT o_orderkey, {scaled} FROM p, b WHERE {apply_where}"""


@query("min_max", scaled_sql("true", "true"))
def min_max(spark, sf):
    df = i.order_table(spark, sf).select("o_orderkey", *NUMERIC)
    return rounded(prepare.min_max(df, NUMERIC))


@query("min_max_apply", scaled_sql("train", "NOT train"))
def min_max_apply(spark, sf):
    df = i.order_table(spark, sf).select("o_orderkey", *NUMERIC)
    train, rest = rows.hash_split(df, i.WEIGHTS, ["o_orderkey"], i.SEED)
    root = fresh_path(spark, "models")
    models.write_model(prepare.min_max_fit(train, NUMERIC), root, "orders")
    return rounded(models.load_ranges(spark, root, "orders").apply(rest))


# Naive Bayes on columns

GRID = " UNION ALL ".join(
    f"SELECT '{c}' AS name, {c} AS value, k.class, count(t.class) AS n "
    f"FROM (SELECT DISTINCT {c} FROM t) v CROSS JOIN (SELECT DISTINCT class FROM t) k "
    f"LEFT JOIN t USING ({c}, class) GROUP BY ALL"
    for c in NOMINAL
)
MIXED = f"""t AS (
  SELECT o_orderkey, {', '.join(NUMERIC + NOMINAL)}, o_orderstatus AS class
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
grid AS ({GRID}),
num AS (
  SELECT class, count(*) AS docs, count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE) AS prior,
    {', '.join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS d_{c}, sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in NUMERIC)}
  FROM t GROUP BY class),
prob AS (SELECT name, value, class, n, n / sum(n) OVER (PARTITION BY name, class) AS p FROM grid)"""


def gauss_sql(c: str) -> str:
    return f"-ln(d_{c} * sqrt(2 * pi())) - (t.{c} - m_{c}) * (t.{c} - m_{c}) / (d_{c} * d_{c}) / 2"


MIXED_PREDICT = f"""{MIXED},
s AS (
  SELECT o_orderkey, t.class AS label, num.class AS predicted,
    round(ln(prior) + {' + '.join(gauss_sql(c) for c in NUMERIC)}
      + {' + '.join(f"CASE WHEN p_{c}.p > 0 THEN ln(p_{c}.p) ELSE '-infinity'::DOUBLE END" for c in NOMINAL)}, 9) AS score
  FROM t CROSS JOIN num
  {' '.join(f"JOIN prob p_{c} ON p_{c}.name = '{c}' AND p_{c}.value = t.{c} AND p_{c}.class = num.class" for c in NOMINAL)}),
pred AS (
  SELECT o_orderkey, label, predicted FROM s
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, predicted) = 1)"""


def mixed_model(table):
    return mixed_bayes.mixed_fit(table, TARGET, NUMERIC, NOMINAL)


def mixed_predictions(spark, sf):
    """Learner and predictor read one stored table: the joins run once."""
    table = written(classed(spark, sf, "o_orderkey"), "orders")
    df = mixed_model(table).predict(table, "predicted")
    return df.select("o_orderkey", F.col(TARGET).alias("label"), "predicted")


@query(
    "nb_sufficient_stats",
    f"""WITH {MIXED}
{' UNION ALL '.join(
    f"SELECT class, '{c}' AS name, NULL AS value, docs AS n, round(s_{c} / 1e6, 3) AS sum_m, "
    f"round(q_{c} / 1e12, 3) AS square_sum_t FROM num" for c in NUMERIC)}
UNION ALL SELECT class, name, value, n, NULL, NULL FROM grid WHERE n > 0""",
)
def nb_sufficient_stats(spark, sf):
    found = mixed_bayes.sufficient_stats(classed(spark, sf), TARGET, NUMERIC, NOMINAL)
    return found.select(
        "class",
        "name",
        "value",
        "n",
        F.round(F.col("sum") / 1e6, 3).alias("sum_m"),
        F.round(F.col("square_sum") / 1e12, 3).alias("square_sum_t"),
    )


@query(
    "nb_statistics",
    f"""WITH {MIXED}
{' UNION ALL '.join(
    f"SELECT '{c}' AS attribute, NULL AS value, class, docs AS count, round(m_{c}, 4) AS mean, "
    f"round(d_{c}, 4) AS std FROM num" for c in NUMERIC)}
UNION ALL SELECT name, value, class, n, NULL, NULL FROM grid
UNION ALL SELECT '{TARGET}', NULL, class, docs, NULL, NULL FROM num""",
)
def nb_statistics(spark, sf):
    found = mixed_model(classed(spark, sf)).statistics(spark)
    return found.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "nb_mixed_fit",
    f"""WITH {MIXED} SELECT name, value, class, n, round(p, 9) AS probability FROM prob
UNION ALL SELECT '{TARGET}', NULL, class, docs, round(prior, 9) FROM num
UNION ALL SELECT 'c_name', NULL, NULL, NULL, NULL""",
)
def nb_mixed_fit(spark, sf):
    """The stored model; one column has too many values and is listed as skipped."""
    root = fresh_path(spark, "models")
    model = mixed_bayes.mixed_fit(classed(spark, sf, "c_name"), TARGET, NUMERIC, [*NOMINAL, "c_name"])
    models.write_model(model, root, "orders")
    stored = models.load_parameters(spark, root, "table_bayes", "orders")
    # One row by value and class: a small table.
    share = F.sum("count").over(mixed_bayes.share_of(TARGET))
    return stored.where(F.col("mean").isNull()).select(
        F.col("attribute").alias("name"),
        "value",
        "class",
        F.col("count").alias("n"),
        F.round(F.col("count") / share, 9).alias("probability"),
    )


@query("nb_mixed_predict", f"WITH {MIXED_PREDICT} SELECT * FROM pred")
def nb_mixed_predict(spark, sf):
    return mixed_predictions(spark, sf)


@query("stored_model_predict", f"WITH {MIXED_PREDICT} SELECT * FROM pred")
def stored_model_predict(spark, sf):
    """A table model stored under an id, loaded by it and applied."""
    table, root = classed(spark, sf, "o_orderkey"), fresh_path(spark, "models")
    models.write_model(mixed_model(table), root, "orders")
    df = models.load_table_bayes(spark, root, "orders", TARGET).predict(table, "predicted")
    return df.select("o_orderkey", F.col(TARGET).alias("label"), "predicted")


# Scores

CELLS = f"{MIXED_PREDICT}, c AS (SELECT label, predicted, count(*) AS n FROM pred GROUP BY ALL)"


@query(
    "confusion_matrix",
    f"""WITH {CELLS}, k AS (SELECT DISTINCT class FROM t)
SELECT class AS actual,
  {', '.join(f"CAST(coalesce(sum(n) FILTER (predicted = '{v}'), 0) AS BIGINT) AS " + f'"p_{v}"' for v in STATUSES)}
FROM k LEFT JOIN c ON label = class GROUP BY class""",
)
def confusion_matrix(spark, sf):
    table = written(classed(spark, sf), "orders")
    model = mixed_model(table)
    predicted = model.predict(table, "predicted")
    return score.confusion_matrix(predicted, TARGET, "predicted", list(model.classes))


ROLES = f"""{CELLS},
k AS (SELECT label AS class FROM c UNION SELECT predicted FROM c),
r AS (
  SELECT class, sum(n) AS n, coalesce(sum(n) FILTER (label = class AND predicted = class), 0) AS tp,
    coalesce(sum(n) FILTER (label <> class AND predicted = class), 0) AS fp,
    coalesce(sum(n) FILTER (label <> class AND predicted <> class), 0) AS tn,
    coalesce(sum(n) FILTER (label = class AND predicted <> class), 0) AS fn
  FROM k CROSS JOIN c GROUP BY class),
whole AS (
  SELECT sum(tp) AS correct, any_value(n) AS n, sum(tp) / any_value(n)::DOUBLE AS accuracy,
    sum((tp + fn)::DOUBLE * (tp + fp)) / (any_value(n)::DOUBLE * any_value(n)) AS chance FROM r)"""


@query(
    "class_statistics",
    f"""WITH {ROLES}, q AS (
  SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision FROM r)
SELECT class, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn,
  round(recall, 9) AS recall, round(precision, 9) AS precision, round(recall, 9) AS sensitivity,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE END, 9) AS specificity,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 9) AS f_measure,
  NULL::DOUBLE AS accuracy, NULL::DOUBLE AS kappa FROM q
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(accuracy, 9),
  round((accuracy - chance) / (1 - chance), 9) FROM whole""",
)
def class_statistics(spark, sf):
    found = score.class_statistics(mixed_predictions(spark, sf), "label", "predicted")
    return found.withColumns({c: F.round(c, 9) for c, t in found.dtypes if t == "double"})


@query(
    "scorer_totals",
    f"""WITH {ROLES} SELECT round(accuracy, 9) AS accuracy, round(1 - accuracy, 9) AS error,
  correct::BIGINT AS correct, (n - correct)::BIGINT AS false,
  round((accuracy - chance) / (1 - chance), 9) AS kappa FROM whole""",
)
def scorer_totals(spark, sf):
    found = score.scorer_totals(mixed_predictions(spark, sf), "label", "predicted")
    return found.withColumns({c: F.round(c, 9) for c, t in found.dtypes if t == "double"})


# Learners of the ML library: the class is whether a line was returned

RETURNED, KEPT = "R", "N"
LINE_KEY = ["l_orderkey", "l_linenumber"]


def lines(spark, sf):
    """Lines with their key and class; the learners do not see the key."""
    returned = F.when(F.col("l_returnflag") == "R", RETURNED).otherwise(KEPT)
    fields = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag"]
    return i.table(spark, sf, "lineitem", [*LINE_KEY, *fields]).withColumn("l_returnflag", returned)


VARIABLES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus=O", "Constant"]


def least_squares_sql(rounds: int = 7) -> str:
    """Iteratively reweighted least squares, unrolled: the sums of a round, then its elimination, column by column.

    ``m`` has the cells of the matrix (column 7: the right side; columns 8 to 13: the identity in the last
    round, which becomes the inverse). Numbers are centred and scaled, and the result is taken back.
    """
    p = len(VARIABLES)
    numbers = VARIABLES[:4]
    scaled = ", ".join(
        f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem) AS x{i + 1}" for i, c in enumerate(numbers)
    )
    parts = [
        f"""x AS MATERIALIZED (
  SELECT {scaled}, CASE l_linestatus WHEN 'O' THEN 1e0 ELSE 0e0 END AS x5, 1e0 AS x6,
    CASE l_returnflag WHEN 'R' THEN 1e0 ELSE 0e0 END AS y FROM lineitem)""",
        "b0 AS (SELECT i, 0e0 AS v FROM range(1, 7) r(i))",
    ]
    for t in range(rounds + 1):
        odds = " + ".join(f"x{i} * (SELECT v FROM b{t} WHERE i = {i})" for i in range(1, p + 1))
        sums = [f"sum(w * x{i} * x{j}) AS m{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1)]
        sums += [f"sum((y - c) * x{i}) AS g{i}" for i in range(1, p + 1)]
        cells = [f"({i}, {j}, m{min(i, j)}_{max(i, j)})" for i in range(1, p + 1) for j in range(1, p + 1)]
        cells += [f"({i}, {p + 1}, g{i})" for i in range(1, p + 1)]
        if t == rounds:
            cells += [f"({i}, {p + 1 + j}, {1 if i == j else 0}e0)" for i in range(1, p + 1) for j in range(1, p + 1)]
        parts.append(
            f"""s{t} AS MATERIALIZED (
  SELECT {', '.join(sums)} FROM (SELECT *, c * (1 - c) AS w FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS c FROM x))),
e{t}_0 AS MATERIALIZED (SELECT r.* FROM s{t}, LATERAL (VALUES {', '.join(cells)}) r(i, j, v))"""
        )
        for k in range(1, p + 1):
            parts.append(
                f"""e{t}_{k} AS MATERIALIZED (
  SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / d.v ELSE a.v - q.v * r.v / d.v END AS v
  FROM e{t}_{k - 1} a JOIN e{t}_{k - 1} r ON r.i = {k} AND r.j = a.j JOIN e{t}_{k - 1} q ON q.i = a.i AND q.j = {k}
    CROSS JOIN (SELECT v FROM e{t}_{k - 1} WHERE i = {k} AND j = {k}) d)"""
            )
        if t < rounds:
            parts.append(f"b{t + 1} AS MATERIALIZED (SELECT i, b.v + e.v AS v FROM b{t} b JOIN e{t}_{p} e USING (i) WHERE j = {p + 1})")
    # The constant takes up the centres: row 6 of ``back`` has minus centre by scale.
    centre = " ".join(f"WHEN {i + 1} THEN (SELECT avg({c}) FROM lineitem)" for i, c in enumerate(numbers))
    width = " ".join(f"WHEN {i + 1} THEN (SELECT stddev_pop({c}) FROM lineitem)" for i, c in enumerate(numbers))
    parts.append(
        f"""unit AS (SELECT i, CASE i {centre} ELSE 0e0 END AS c, CASE i {width} ELSE 1e0 END AS w FROM range(1, 7) r(i)),
back AS (
  SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1 / a.w ELSE 0e0 END - CASE WHEN a.i = {p} THEN b.c / b.w ELSE 0 END AS v
  FROM unit a CROSS JOIN unit b),
coeff AS (SELECT back.i, sum(back.v * b.v) AS coeff FROM back JOIN b{rounds} b ON b.i = back.j GROUP BY back.i),
error AS (
  SELECT l.i, sqrt(sum(l.v * e.v * r.v)) AS std_err
  FROM back l JOIN e{rounds}_{p} e ON e.i = l.j JOIN back r ON r.j = e.j - {p + 1} AND r.i = l.i WHERE e.j > {p + 1} GROUP BY l.i)"""
    )
    return ",\n".join(parts)


NAMES_SQL = ", ".join(f"({n + 1}, '{v}')" for n, v in enumerate(VARIABLES))


@query(
    "logit_table",
    f"""WITH {least_squares_sql()}
SELECT 'R' AS logit, name AS variable, round(coeff, 6) AS coeff, round(std_err, 6) AS std_err, round(z, 4) AS z_score,
  round(CASE WHEN abs(z) > 8 THEN 0 ELSE
    1 - exp(-z * z / 2) * list_sum(list_transform(range(150), lambda n: pow(abs(z) / sqrt(2), 2 * n + 1) / gamma(n + 1.5))) END, 6) AS p_value
FROM (SELECT *, coeff / std_err AS z FROM (VALUES {NAMES_SQL}) v(i, name) JOIN coeff USING (i) JOIN error USING (i))""",
)
def logit_table(spark, sf):
    df = lines(spark, sf)
    model = linear.logit_fit(df.drop(*LINE_KEY), "l_returnflag", RETURNED)
    digits = {"coeff": 6, "std_err": 6, "z_score": 4, "p_value": 6}
    found = linear.logit_table(model, spark, RETURNED)
    return found.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "logit_predict",
    f"""WITH {least_squares_sql()}, c AS (SELECT i, coeff FROM coeff)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
  CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'N' END AS l_returnflag,
  CASE WHEN {' + '.join(f"{c} * (SELECT coeff FROM c WHERE i = {n + 1})" for n, c in enumerate(VARIABLES[:4]))}
    + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END * (SELECT coeff FROM c WHERE i = 5) + (SELECT coeff FROM c WHERE i = 6) > 0
    THEN 'R' ELSE 'N' END AS predicted FROM lineitem""",
)
def logit_predict(spark, sf):
    df = lines(spark, sf)
    model = linear.logit_fit(df.drop(*LINE_KEY), "l_returnflag", RETURNED)
    return linear.logit_predict(model, df, RETURNED, KEPT, "predicted")


TREE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TREE_DEPTH, TREE_BINS, HELD_OUT = 4, 64, 30


def tree_sql() -> str:
    """Growing, pruning and predicting, unrolled by level; a node is named by its path."""
    key = "l_orderkey || ':' || l_linenumber"
    gini = "({a} + {b} - ({a} * {a} + {b} * {b}) / ({a} + {b}))"
    values = " UNION ALL ".join(f"SELECT {n} AS c, {x} AS x FROM base WHERE train" for n, x in enumerate(TREE_NUMBERS))
    ranges = " ".join(f"JOIN bins b{n} ON b{n}.c = {n} AND {x} >= b{n}.begin AND {x} < b{n}.after" for n, x in enumerate(TREE_NUMBERS))
    kept = "row, class, train, f0, f1, f2, f3, f4"
    parts = [
        f"""base AS MATERIALIZED (
  SELECT *, CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'N' END AS class, {i.unit_sql(key)} < 0.7 AS train,
    row_number() OVER () AS row FROM lineitem),
ranked AS (
  SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY c) AS d,
    coalesce(sum(n) OVER (PARTITION BY c ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(n) OVER (PARTITION BY c) AS total
  FROM (SELECT c, x, count(*) AS n FROM ({values}) GROUP BY c, x)),
filled AS (
  SELECT c, CASE WHEN d <= {TREE_BINS} THEN r ELSE floor(CAST(below AS DOUBLE) * {TREE_BINS} / total) END AS bin, min(x) AS low
  FROM ranked GROUP BY ALL),
bins AS MATERIALIZED (
  SELECT c, row_number() OVER w AS v, CASE WHEN row_number() OVER w = 1 THEN '-infinity'::DOUBLE ELSE low END AS begin,
    coalesce(lead(low) OVER w, 'infinity'::DOUBLE) AS after FROM filled WINDOW w AS (PARTITION BY c ORDER BY bin)),
r0 AS MATERIALIZED (
  SELECT row, class, train, b0.v AS f0, b1.v AS f1, b2.v AS f2, b3.v AS f3, l_linestatus AS f4, 'root' AS node,
    (SELECT class FROM base WHERE train GROUP BY class ORDER BY count(*) DESC, class LIMIT 1) AS label, true AS open
  FROM base {ranges})"""
    ]
    for t in range(TREE_DEPTH):
        cells = " UNION ALL ".join(
            f"SELECT node, {n} AS c, {f'f{n}' if n < 4 else 'NULL'} AS v, {'NULL' if n < 4 else 'f4'} AS s, class FROM r{t} WHERE train AND open" for n in range(5)
        )
        w = "WINDOW w AS (PARTITION BY node, c ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY node, c)"
        parts.append(
            f"""h{t} AS MATERIALIZED (
  SELECT node, c, v, s, count(*) FILTER (class = 'N')::DOUBLE AS a, count(*) FILTER (class = 'R')::DOUBLE AS b FROM ({cells}) GROUP BY ALL),
n{t} AS (
  SELECT node, c, v, la, lb, ta - la AS ha, tb - lb AS hb, ta, tb FROM (
    SELECT node, c, v, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM h{t} WHERE c < 4 {w})
  WHERE la + lb >= 2 AND ta + tb - la - lb >= 2),
g{t} AS (
  SELECT node, c, v, round({gini.format(a='ta', b='tb')} - {gini.format(a='la', b='lb')} - {gini.format(a='ha', b='hb')}, 9) AS gain FROM n{t}
  UNION ALL
  SELECT node, c, NULL, round({gini.format(a='sum(a)', b='sum(b)')} - sum({gini.format(a='a', b='b')}), 9) FROM h{t}
  WHERE c = 4 GROUP BY node, c HAVING count(*) FILTER (a + b >= 2) > 1),
s{t} AS MATERIALIZED (
  SELECT node, c, v FROM g{t} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, c, v) = 1),
c{t} AS MATERIALIZED (
  SELECT node, key, CASE WHEN sum(a) >= sum(b) THEN 'N' ELSE 'R' END AS label,
    sum(a) > 0 AND sum(b) > 0 AND sum(a + b) >= 4 AS open
  FROM (SELECT h.node, CASE WHEN q.v IS NULL THEN h.s WHEN h.v <= q.v THEN 'low' ELSE 'high' END AS key, a, b
    FROM h{t} h JOIN s{t} q ON q.node = h.node AND q.c = h.c) GROUP BY node, key),
r{t + 1} AS MATERIALIZED (
  SELECT {kept}, r.node || '/' || k.key AS node, k.label, k.open, r.node AS parent, r.label AS before, q.node IS NOT NULL AS splits
  FROM r{t} r LEFT JOIN s{t} q ON q.node = r.node
    LEFT JOIN c{t} k ON k.node = r.node
      AND k.key = CASE WHEN q.v IS NULL THEN f4 WHEN CASE q.c WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END <= q.v THEN 'low' ELSE 'high' END)"""
        )
    # From below: what a node gets wrong at best, of the rows set aside.
    parts.append(f"e{TREE_DEPTH} AS (SELECT node, parent, count(*) FILTER (label <> class) AS wrong FROM r{TREE_DEPTH} WHERE NOT train AND node IS NOT NULL GROUP BY ALL)")
    for t in reversed(range(TREE_DEPTH)):
        parent = "parent" if t else "NULL AS parent"
        parts.append(
            f"""o{t} AS (
  SELECT parent AS node, count(*) FILTER (before <> class) AS wrong, count(*) FILTER (before <> class AND node IS NULL) AS stay
  FROM r{t + 1} WHERE NOT train AND parent IS NOT NULL AND splits GROUP BY parent),
k{t} AS MATERIALIZED (
  SELECT node, wrong, stay + coalesce(inside, 0) AS inside FROM o{t}
    LEFT JOIN (SELECT parent AS node, sum(wrong) AS inside FROM e{t + 1} GROUP BY parent) USING (node)),
e{t} AS (
  SELECT node, parent, CASE WHEN k.node IS NOT NULL AND k.inside < k.wrong THEN k.inside ELSE m.wrong END AS wrong
  FROM (SELECT node, {parent}, count(*) FILTER (label <> class) AS wrong FROM r{t} WHERE NOT train AND node IS NOT NULL GROUP BY ALL) m
    LEFT JOIN k{t} k USING (node))"""
        )
    parts.append("w0 AS (SELECT row, label AS predicted, true AS goes FROM r0)")
    for t in range(TREE_DEPTH):
        parts.append(
            f"""w{t + 1} AS (
  SELECT row, CASE WHEN goes AND k.node IS NOT NULL AND r.node IS NOT NULL THEN r.label ELSE predicted END AS predicted,
    goes AND k.node IS NOT NULL AND r.node IS NOT NULL AS goes
  FROM w{t} JOIN r{t + 1} r USING (row) LEFT JOIN k{t} k ON k.node = r.parent AND k.inside < k.wrong)"""
        )
    return ",\n".join(parts)


@query(
    "tree_predict",
    f"""WITH {tree_sql()}
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, class AS l_returnflag, predicted
FROM base JOIN w{TREE_DEPTH} USING (row)""",
)
def tree_predict(spark, sf):
    """A pruned tree of all lines; its depth is bounded as the SQL unrolls it."""
    df = lines(spark, sf)
    model = tree.tree_fit(df, "l_returnflag", keys=LINE_KEY, max_depth=TREE_DEPTH, max_bins=TREE_BINS, held_out=HELD_OUT)
    return tree.tree_predict(model, df)


@query("svm_rbf_predict")
def svm_rbf_predict(spark, sf):
    coded = prepare.one_hot(lines(spark, sf), ["l_linestatus"])
    columns = [c for c, t in coded.dtypes if t in prepare.NUMERIC and c not in LINE_KEY]
    scaled = prepare.min_max(coded, columns).withColumn(
        "label", (F.col("l_returnflag") == RETURNED).cast("double")
    )
    model, features = linear.svm_rbf_fit(scaled, columns, c=1.0, sigma=0.1)
    return linear.svm_rbf_predict(model, features, scaled, [KEPT, RETURNED], "predicted")
