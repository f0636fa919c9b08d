"""Text: cleaning, tokens, vocabularies, vectors, classifiers on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelkite.functions import clean_text, encode_label, join_tokens
from labelkite.operators import bayes, linear, rows, score, vectors, vocab
from labelkite.plans import inputs as i
from labelkite.plans.registry import Registry
from labelkite.shared import fresh_path, written
from labelkite.sources import models

registry = Registry()
query = registry.query


@query("clean_text", f"SELECT doc_id, {i.clean_sql('text')} AS clean FROM documents")
def clean_text_query(spark, sf):
    return i.documents(spark, sf).select("doc_id", clean_text("text").alias("clean"))


@query("tokenize",
    f"""WITH t AS (SELECT doc_id, {i.tokens_sql('text')} AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n_tokens, coalesce(list_aggregate(tokens, 'string_agg', ' '), '') AS tokens
FROM t"""
)
def tokenize_query(spark, sf):
    return i.document_tokens(spark, sf).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.concat_ws(" ", "tokens").alias("tokens"),
    )


@query("join_tokens",
    f"""WITH t AS (SELECT doc_id, {i.tokens_sql('text')} AS tokens FROM documents)
SELECT doc_id, coalesce(' ' || list_aggregate(tokens, 'string_agg', ' '), '') AS joined FROM t"""
)
def join_tokens_query(spark, sf):
    return i.document_tokens(spark, sf).select("doc_id", join_tokens("tokens").alias("joined"))


@query("drop_empty",
    f"""WITH t AS (SELECT doc_id, {i.tokens_sql('text')} AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n_tokens FROM t WHERE len(tokens) > 0"""
)
def drop_empty(spark, sf):
    kept = rows.drop_empty_vectors(i.document_tokens(spark, sf))
    return kept.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query("label_encode",
    """WITH t AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label
  FROM labels)
SELECT doc_id, label, CASE WHEN label = 'positive' THEN 1e0 ELSE 0e0 END AS by_positive,
  CASE WHEN label = 'negative' THEN 0e0 ELSE 1e0 END AS by_negative FROM t"""
)
def label_encode(spark, sf):
    label = (
        F.when(F.col("toxic") == 1, "toxic")
        .when(F.col("quality") == 1, "positive")
        .otherwise("negative")
    )
    named = i.table(spark, sf, "labels").select("doc_id", label.alias("label"))
    return named.select(
        "doc_id",
        "label",
        encode_label(F.col("label"), "positive").alias("by_positive"),
        encode_label(F.col("label"), "negative").alias("by_negative"),
    )


@query("count_vectorize",
    f"""WITH t AS (
  SELECT doc_id, unnest({i.tokens_sql('text')}) AS term FROM documents)
SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) >= 2 GROUP BY doc_id, term"""
)
def count_vectorize(spark, sf):
    return vectors.term_counts(i.document_tokens(spark, sf), "doc_id", min_length=2)


@query("vocab_all_terms", f"WITH {i.TERMS} SELECT term, doc_freq FROM vocab")
def vocab_all_terms(spark, sf):
    return vocab.doc_freq(i.document_tokens(spark, sf))


@query("vocab_index", f"WITH {i.TERMS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab")
def vocab_index(spark, sf):
    return vocab.assign_index(vocab.doc_freq(i.document_tokens(spark, sf))).select("term", "idx")


SIGNIFICANT = f"""{i.LABELS}, {i.TERMS},
sizes AS (SELECT label, count(*) AS size FROM lab GROUP BY label),
fg AS (SELECT label, term, count(*) AS fg FROM tok JOIN lab USING (doc_id) GROUP BY label, term),
bg AS (SELECT term, count(*) AS bg FROM tok JOIN lab USING (doc_id) GROUP BY term),
share AS (
  SELECT label, term, fg, bg, fg / CAST(size AS DOUBLE) AS f,
    bg / CAST((SELECT count(*) FROM lab) AS DOUBLE) AS b
  FROM fg JOIN bg USING (term) JOIN sizes USING (label)),
scored AS (SELECT label, term, fg, bg, round((f - b) * f / b, 9) AS score FROM share),
best AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, term) AS rank
  FROM scored WHERE score > 0 QUALIFY rank <= 10000)"""


def significant(spark, sf):
    docs = i.labelled(spark, sf).select("doc_id", "label", i.tokenize("text").alias("tokens"))
    return vocab.significant_terms(docs, size=10_000)


@query("significant_terms", f"WITH {SIGNIFICANT} SELECT label, rank, term, fg, bg, round(score, 6) AS score FROM best")
def significant_terms(spark, sf):
    return significant(spark, sf).withColumn("score", F.round("score", 6))


@query("vocab_significant",
    f"""WITH {SIGNIFICANT}, terms AS (SELECT DISTINCT term FROM best)
SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM terms"""
)
def vocab_significant(spark, sf):
    return vocab.assign_index(significant(spark, sf).select("term").distinct())


@query("doc_vectors",
    f"""WITH {i.TERMS},
spec AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab),
e AS (SELECT doc_id, idx FROM tok JOIN spec USING (term))
SELECT doc_id, count(idx) AS n_features, coalesce(string_agg(idx, ',' ORDER BY idx), '') AS indices
FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id"""
)
def doc_vectors(spark, sf):
    tokens = i.document_tokens(spark, sf)
    spec, _ = vocab.vocabulary_spec(vocab.doc_freq(tokens), "all_terms")
    return vectors.doc_vectors(tokens, spec, "doc_id").select(
        "doc_id",
        F.size("indices").cast("long").alias("n_features"),
        F.concat_ws(",", F.col("indices").cast("array<string>")).alias("indices"),
    )


# Naive Bayes on terms

BAYES = f"""{i.SPLIT}, {i.TERMS},
x AS (SELECT doc_id, term, label, train FROM tok JOIN vocab USING (term) JOIN part USING (doc_id)),
classes AS (
  SELECT label, count(*) AS docs,
    ln((count(*) + 1e0) / ((SELECT count(*) FROM part WHERE train) + 2e0)) AS prior
  FROM part WHERE train GROUP BY label),
cnt AS (SELECT label, term, count(*) AS n FROM x WHERE train GROUP BY label, term),
tot AS (
  SELECT label, sum(n) + (SELECT count(*) FROM vocab) AS total FROM cnt GROUP BY label),
theta AS (
  SELECT label, term, coalesce(n, 0) AS n, ln((coalesce(n, 0) + 1e0) / total) AS weight
  FROM (SELECT term, label FROM vocab CROSS JOIN classes)
    LEFT JOIN cnt USING (term, label) JOIN tot USING (label)),
scores AS (
  SELECT p.doc_id, p.label, c.label AS predicted, round(c.prior + coalesce(sum(theta.weight), 0), 9) AS score
  FROM part p CROSS JOIN classes c LEFT JOIN x ON x.doc_id = p.doc_id
    LEFT JOIN theta ON theta.term = x.term AND theta.label = c.label
  WHERE NOT p.train GROUP BY p.doc_id, p.label, c.label, c.prior),
pred AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, predicted) = 1)"""


def fitted_bayes(spark, sf):
    train, test = i.split_tokens(spark, sf)
    return bayes.multinomial_fit(train, i.vocabulary(spark, sf)), test


def bayes_predictions(spark, sf):
    model, test = fitted_bayes(spark, sf)
    return bayes.multinomial_predict(model, test, "doc_id", ["label"])


@query("nb_fit", f"WITH {BAYES} SELECT term, label, CAST(n AS DOUBLE) AS count, round(weight, 6) AS weight FROM theta")
def nb_fit(spark, sf):
    return fitted_bayes(spark, sf)[0].weights().withColumn("weight", F.round("weight", 6))


@query("nb_predict", f"WITH {BAYES} SELECT doc_id, label, predicted, round(score, 6) AS score FROM pred")
def nb_predict(spark, sf):
    return bayes_predictions(spark, sf).withColumn("score", F.round("score", 6))


@query("accuracy",
    f"""WITH {BAYES} SELECT round(avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END), 9) AS accuracy,
  count(*) AS n FROM pred"""
)
def accuracy(spark, sf):
    found = score.accuracy(bayes_predictions(spark, sf))
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query("actual_vs_predicted",
    f"""WITH {BAYES} SELECT label, predicted, count(*) AS n, sum(count(*)) OVER (PARTITION BY label) AS bucket,
  row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, predicted) AS rank
FROM pred GROUP BY label, predicted"""
)
def actual_vs_predicted(spark, sf):
    return score.nested_terms(bayes_predictions(spark, sf), "label", "predicted")


@query("model_roundtrip", f"WITH {BAYES} SELECT doc_id, label, predicted, round(score, 6) AS score FROM pred")
def model_roundtrip(spark, sf):
    model, test = fitted_bayes(spark, sf)
    root = fresh_path(spark, "models")
    models.write_model(model, root, "naive_bayes", "all_terms")
    loaded = models.load_term_bayes(spark, root, "naive_bayes", "all_terms")
    found = bayes.multinomial_predict(loaded, test, "doc_id", ["label"])
    return found.withColumn("score", F.round("score", 6))


@query("predicted_field", f"WITH {BAYES} SELECT doc_id, lang, p.predicted FROM pred p JOIN documents USING (doc_id)")
def predicted_field(spark, sf):
    """Documents of the test part with the predicted class as one more field.

    The split is a filter on the id, so texts are scored where they are read. Only ids and classes meet the labels.
    """
    model, _ = fitted_bayes(spark, sf)
    docs = rows.hash_split(i.table(spark, sf, "documents", ["doc_id", "lang", "text"]), i.WEIGHTS, ["doc_id"], i.SEED)[1]
    found = bayes.predicted_field(docs, model, "doc_id", i.tokenize("text")).select("doc_id", "lang", "predicted")
    return found.join(i.labels(spark, sf), "doc_id", "left_semi")


# Iterative learners


def svm_predictions(spec, train, test):
    """The weights are stored under a model id, and the stored model is applied."""
    spark = test.sparkSession
    root = fresh_path(spark, "models")
    table = linear.svm_sgd_fit(train, spec, "doc_id", "label", "positive")
    models.write_parameters(table, root, "term_weights", "svm", "all_terms")
    stored = models.load_parameters(spark, root, "term_weights", "svm", "all_terms")
    scored = linear.score_by_model(test, stored, "doc_id", ["label"])
    return scored.withColumn("predicted", linear.margin_class(F.col("margin")))


def logistic_predictions(spec, train, test, c=None):
    """The weights are stored under a model id, loaded, and applied to the test documents."""
    spark = test.sparkSession
    root = fresh_path(spark, "models")
    table = linear.logistic_terms_fit(train, spec, "doc_id", "label", "positive", c)
    models.write_parameters(table, root, "term_weights", "logistic", "all_terms")
    stored = models.load_parameters(spark, root, "term_weights", "logistic", "all_terms")
    constant = stored.where(F.col("term") == linear.BIAS).first()
    scored = linear.score_by_model(test, stored, "doc_id", ["label"])
    margin = F.round(F.col("margin") + (constant["weight"] if constant else 0.0), 9)
    return scored.select("doc_id", "label", linear.margin_class(margin).alias("predicted"))


def descent_sql(iterations: int = 10, step: float = 0.1, reg: float = 0.01, tol: float = 0.001) -> str:
    """Full-batch descent on hinge loss, a few common table expressions by step.

    As the learner does, it stops after the step (the second at the earliest) that moves the weights
    by less than ``tol`` of their length, or of 1: later steps then copy the weights. Margins are
    compared to 12 digits, so that one of exactly 1 does not depend on the order of the addition.
    """
    parts = ["w0 AS (SELECT term, 0e0 AS w FROM vocab), c0 AS (SELECT false AS stop)"]
    for t in range(1, iterations + 1):
        rate = f"({step!r}e0 / sqrt({t}e0))"
        still = f"sqrt(sum(pow(a.w - b.w, 2))) < {tol!r}e0 * greatest(sqrt(sum(a.w * a.w)), 1)"
        parts.append(
            f"""m{t} AS MATERIALIZED (
  SELECT p.doc_id, p.y FROM tr p LEFT JOIN x ON x.doc_id = p.doc_id LEFT JOIN w{t - 1} USING (term)
  GROUP BY p.doc_id, p.y HAVING round(p.y * coalesce(sum(w), 0), 12) < 1),
g{t} AS MATERIALIZED (SELECT term, sum(-y) AS g FROM x JOIN m{t} USING (doc_id) GROUP BY term),
w{t} AS MATERIALIZED (
  SELECT term, CASE WHEN (SELECT stop FROM c{t - 1}) THEN w ELSE
    w * (1 - {rate} * {reg!r}e0) - {rate} * coalesce(g, 0) / (SELECT count(*) FROM tr) END AS w
  FROM w{t - 1} LEFT JOIN g{t} USING (term)),
c{t} AS MATERIALIZED (
  SELECT {still if t > 1 else "bool_and(false)"} AS stop FROM w{t} a JOIN w{t - 1} b USING (term))"""
        )
    return ",\n".join(parts)


@query("svm_predict",
    f"""WITH {i.SPLIT}, {i.TERMS},
tr AS (SELECT doc_id, CASE label WHEN 'positive' THEN 1e0 ELSE -1e0 END AS y FROM part WHERE train),
x AS MATERIALIZED (SELECT doc_id, term FROM tok JOIN vocab USING (term) JOIN part USING (doc_id)),
{descent_sql()}
SELECT p.doc_id, p.label, round(round(coalesce(sum(w), 0), 9), 6) AS margin,
  CASE WHEN coalesce(sum(w), 0) > 0 THEN 'positive' ELSE 'negative' END AS predicted
FROM part p LEFT JOIN x ON x.doc_id = p.doc_id LEFT JOIN w10 USING (term)
WHERE NOT p.train GROUP BY p.doc_id, p.label"""
)
def svm_predict(spark, sf):
    train, test = i.split_tokens(spark, sf)
    spec, _ = vocab.vocabulary_spec(vocab.doc_freq(i.document_tokens(spark, sf)), "all_terms")
    found = svm_predictions(written(spec, "spec"), train, test)
    return found.withColumn("margin", F.round("margin", 6))


def quasi_newton_sql(l2: str, iterations: int = 10, history: int = 4) -> str:
    """L-BFGS with its vectors as tables, unrolled: the two loops, the line search, the gradient."""
    penalty = f"CASE WHEN term = '' THEN 0e0 ELSE {l2} END"
    n = "(SELECT count(*) FROM tr)"
    gradient = f"""SELECT term, coalesce(g, 0) + {penalty} * w AS g FROM w{{t}} LEFT JOIN (
    SELECT term, sum(-y / (1 + exp(y * m))) / {n} AS g FROM x JOIN m{{t}} USING (doc_id) GROUP BY term) USING (term)"""
    parts = [
        "w0 AS MATERIALIZED (SELECT term, 0e0 AS w FROM features)",
        "m0 AS MATERIALIZED (SELECT doc_id, y, 0e0 AS m FROM tr WHERE doc_id IN (SELECT doc_id FROM x))",
        f"g0 AS MATERIALIZED ({gradient.format(t=0)})",
    ]
    for t in range(iterations):
        pairs = list(range(max(0, t - history), t))
        parts.append(f"q{t}_0 AS MATERIALIZED (SELECT term, g AS q FROM g{t})")
        k = 0
        for j in reversed(pairs):
            parts.append(
                f"""a{t}_{j} AS MATERIALIZED (SELECT sum(s * q) / (SELECT sc FROM r{j}) AS a FROM p{j} JOIN q{t}_{k} USING (term)),
q{t}_{k + 1} AS MATERIALIZED (SELECT term, q - (SELECT a FROM a{t}_{j}) * c AS q FROM q{t}_{k} JOIN p{j} USING (term))"""
            )
            k += 1
        if pairs:
            parts.append(f"q{t}_{k + 1} AS MATERIALIZED (SELECT term, q * (SELECT sc / cc FROM r{t - 1}) AS q FROM q{t}_{k})")
            k += 1
        for j in pairs:
            parts.append(
                f"""b{t}_{j} AS MATERIALIZED (SELECT sum(c * q) / (SELECT sc FROM r{j}) AS b FROM p{j} JOIN q{t}_{k} USING (term)),
q{t}_{k + 1} AS MATERIALIZED (
  SELECT term, q + ((SELECT a FROM a{t}_{j}) - (SELECT b FROM b{t}_{j})) * s AS q FROM q{t}_{k} JOIN p{j} USING (term))"""
            )
            k += 1
        parts.append(
            f"""d{t} AS MATERIALIZED (SELECT term, -q AS d, w FROM q{t}_{k} JOIN w{t} USING (term)),
v{t} AS MATERIALIZED (
  SELECT doc_id, y, m, md FROM m{t} JOIN (SELECT doc_id, sum(d) AS md FROM x JOIN d{t} USING (term) GROUP BY doc_id) USING (doc_id)),
l{t} AS MATERIALIZED (
  SELECT arg_min(len, f) AS len FROM (
    SELECT pow(2e0, e) AS len, (SELECT sum(ln(1 + exp(-y * (m + pow(2e0, e) * md)))) FROM v{t}) / {n}
      + (SELECT sum({penalty} * pow(w + pow(2e0, e) * d, 2)) FROM d{t}) / 2 AS f FROM range(-7, 4) r(e))),
w{t + 1} AS MATERIALIZED (SELECT term, w + (SELECT len FROM l{t}) * d AS w FROM d{t}),
m{t + 1} AS MATERIALIZED (SELECT doc_id, y, m + (SELECT len FROM l{t}) * md AS m FROM v{t}),
g{t + 1} AS MATERIALIZED ({gradient.format(t=t + 1)}),
p{t} AS MATERIALIZED (
  SELECT term, (SELECT len FROM l{t}) * d AS s, b.g - a.g AS c FROM d{t} JOIN g{t} a USING (term) JOIN g{t + 1} b USING (term)),
r{t} AS MATERIALIZED (SELECT sum(s * c) AS sc, sum(c * c) AS cc FROM p{t})"""
        )
    return ",\n".join(parts)


def logistic_sql(l2: str = "0e0", constant: bool = False, iterations: int = 10) -> str:
    bias = " UNION ALL SELECT ''" if constant else ""
    ones = " UNION ALL SELECT doc_id, '' FROM tr" if constant else ""
    margin = f"coalesce(sum(w), 0){f' + (SELECT w FROM w{iterations} WHERE term = {chr(39) * 2})' if constant else ''}"
    return f"""WITH {i.SPLIT}, {i.TERMS},
tr AS MATERIALIZED (SELECT doc_id, CASE label WHEN 'positive' THEN 1e0 ELSE -1e0 END AS y FROM part WHERE train),
known AS MATERIALIZED (SELECT doc_id, term FROM tok JOIN vocab USING (term) JOIN part USING (doc_id)),
features AS (SELECT term FROM vocab{bias}),
x AS MATERIALIZED (SELECT doc_id, term FROM known JOIN tr USING (doc_id){ones}),
{quasi_newton_sql(l2, iterations)}
SELECT p.doc_id, p.label, CASE WHEN round({margin}, 9) > 0 THEN 'positive' ELSE 'negative' END AS predicted
FROM part p LEFT JOIN known k ON k.doc_id = p.doc_id LEFT JOIN w{iterations} USING (term)
WHERE NOT p.train GROUP BY p.doc_id, p.label"""


@query("lr_predict", logistic_sql())
def lr_predict(spark, sf):
    train, test = i.split_tokens(spark, sf)
    return logistic_predictions(i.vocabulary(spark, sf), train, test)


@query("lr_l2_predict", logistic_sql("(1e0 / (SELECT count(*) FROM tr))", constant=True))
def lr_l2_predict(spark, sf):
    train, test = i.split_tokens(spark, sf)
    return logistic_predictions(i.vocabulary(spark, sf), train, test, c=1.0)


@query("compare_models")
def compare_models(spark, sf):
    train, test = i.split_tokens(spark, sf)
    spec = i.vocabulary(spark, sf)
    naive = bayes.multinomial_fit(train, spec)
    return score.compare_accuracy(
        {
            "naive_bayes": bayes.multinomial_predict(naive, test, "doc_id", ["label"]),
            "svm": svm_predictions(spec, train, test),
            "logistic": logistic_predictions(spec, train, test),
        },
        "label",
        "predicted",
    )
