"""Readers, writers, row operators and threads.

The readers of lines get files that Spark writes to the shared folder first. The readers of one file
by document or thread are parsers over rows of path and content, which are made from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.functions import clean_text
from labelkite.functions.text import keyword
from labelkite.operators import rows, score, skew, threads
from labelkite.plans import inputs as i
from labelkite.plans.registry import Registry
from labelkite.shared import fresh_path, written
from labelkite.sources import census, labelled, messages, tables

registry = Registry()
query = registry.query


# Readers


@query(
    "read_labelled_dirs",
    f"""WITH {i.LABELS}
SELECT label, translate(text || chr(10), chr(10) || '"\\', '   ') AS text
FROM documents JOIN lab USING (doc_id)""",
)
def read_labelled_dirs(spark, sf):
    value = F.concat("text", F.lit("\n")).alias("value")
    return labelled.labelled_texts(i.labelled(spark, sf).select("label", value))


@query(
    "sequential_ids",
    f"""WITH {i.LABELS}
SELECT row_number() OVER (ORDER BY label DESC, CAST(doc_id AS VARCHAR)) AS id, doc_id,
  CASE label WHEN 'positive' THEN 'pos' ELSE 'neg' END AS class,
  {i.clean_sql('text || chr(10)')} AS text
FROM documents JOIN lab USING (doc_id)""",
)
def sequential_ids(spark, sf):
    """Documents as files of two folders, numbered, and appended class by class."""
    name = F.when(F.col("label") == "positive", "pos").otherwise("neg").alias("class")
    path = F.concat_ws("/", F.lit("reviews"), "label", F.concat("doc_id", F.lit(".txt"))).alias("path")
    files = i.labelled(spark, sf).select(name, path, F.concat("text", F.lit("\n")).alias("value"))
    found = labelled.number_files(files, ["pos", "neg"])
    path = fresh_path(spark, "reviews-indexed")
    tables.bulk_write([found.where(F.col("class") == c) for c in ("pos", "neg")], path)
    doc_id = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    return tables.read_documents(spark, path).select("id", doc_id.alias("doc_id"), "class", "text")


POLARITY = f"""{i.LABELS}, line AS (
  SELECT label, {i.clean_sql('text')} AS text, '"' || CASE label WHEN 'positive' THEN 4 ELSE 0 END
    || '","' || doc_id || '","2009-04-06","NO_QUERY","' || source || '","' || {i.clean_sql('text')} || '"' AS value
  FROM documents JOIN lab USING (doc_id))"""


def polarity_file(spark, sf) -> str:
    docs = i.table(spark, sf, "documents", ["doc_id", "text", "source"]).join(
        i.labels(spark, sf), "doc_id"
    )
    code = F.when(F.col("label") == "positive", "4").otherwise("0")
    fields = [
        code,
        F.col("doc_id").cast("string"),
        F.lit("2009-04-06"),
        F.lit("NO_QUERY"),
        F.col("source"),
        clean_text("text"),
    ]
    quoted = [F.concat(F.lit('"'), f, F.lit('"')) for f in fields]
    path = fresh_path(spark, "polarity")
    docs.select(F.concat_ws(",", *quoted).alias("value")).write.text(path)
    return path


@query(
    "polarity_csv",
    f"""WITH {POLARITY} SELECT label, trim(coalesce(string_split(value, ',')[6], '')) AS text FROM line""",
)
def polarity_csv(spark, sf):
    return labelled.read_polarity_csv(spark, polarity_file(spark, sf))


@query("polarity_csv_quoted", f"WITH {POLARITY} SELECT label, text FROM line")
def polarity_csv_quoted(spark, sf):
    return labelled.read_polarity_csv(spark, polarity_file(spark, sf), mode="csv")


# Census lines: the order table has 15 fields of the right kinds. Orders of one nation make short
# lines, one status an unreadable number, one priority and one segment the missing token.


def census_lines(spark, sf) -> DataFrame:
    status, segment, nation = F.col("o_orderstatus"), F.col("c_mktsegment"), F.col("n_name")
    unknown = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "?").otherwise(
        F.col("o_orderpriority")
    )
    fields = [
        F.year("o_orderdate"),
        unknown,
        F.when(status == "P", "n/a").otherwise(F.col("o_orderkey").cast("string")),
        segment,
        F.col("c_nationkey"),
        F.lit("Married"),
        F.when(segment == "BUILDING", "?").otherwise(segment),
        F.col("o_orderpriority"),
        F.when(status == "F", "?").otherwise(status),
        F.lit("Female"),
        F.col("o_totalprice"),
        F.col("c_acctbal"),
        F.lit(40.5),
        F.when(nation == "NATION_3", "?").otherwise(nation),
        status,
    ]
    texts = [f.cast("string") for f in fields]
    line = F.when(nation == "NATION_7", F.concat_ws(",", *texts[:3])).otherwise(
        F.concat_ws(", ", *texts)
    )
    return i.order_table(spark, sf).select(line.alias("value"))


CENSUS_VALUES = """
  year(o_orderdate)::INT AS age,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN {none} ELSE o_orderpriority END AS workclass,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END::INT AS fnlwgt,
  c_mktsegment AS education, c_nationkey::INT AS education_num, 'Married' AS marital_status,
  CASE WHEN c_mktsegment = 'BUILDING' THEN {none} ELSE c_mktsegment END AS occupation,
  o_orderpriority AS relationship,
  CASE WHEN o_orderstatus = 'F' THEN {race} ELSE o_orderstatus END AS race, 'Female' AS sex,
  {money}, {hours} AS hours_per_week,
  CASE WHEN n_name = 'NATION_3' THEN {none} ELSE n_name END AS native_country, o_orderstatus AS label"""


@query(
    "census_parse",
    f"""WITH {i.ORDER_TABLE}, whole AS (SELECT {CENSUS_VALUES.format(
        none="''", race="'?'", money="o_totalprice AS capital_gain, c_acctbal AS capital_loss", hours="40.5e0"
    )} FROM t WHERE n_name <> 'NATION_7')
SELECT * FROM whole
UNION ALL SELECT {', '.join(['NULL'] * 15)} FROM t WHERE n_name = 'NATION_7'""",
)
def census_parse(spark, sf):
    path = fresh_path(spark, "census")
    census_lines(spark, sf).write.text(path)
    return census.read_census(spark, path)


@query(
    "census_reader",
    f"""WITH {i.ORDER_TABLE} SELECT {CENSUS_VALUES.format(
        none="NULL", race="NULL", hours="40",
        money="floor(o_totalprice)::INT AS capital_gain, floor(c_acctbal)::INT AS capital_loss"
    )} FROM t""",
)
def census_reader(spark, sf):
    """The same lines with whole numbers and no short line, which the reader does not take."""
    t = i.order_table(spark, sf)
    whole = [
        F.year("o_orderdate"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "?").otherwise(F.col("o_orderpriority")),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderkey").cast("string")),
        F.concat(F.lit("'"), "c_mktsegment", F.lit("'")),
        F.col("c_nationkey"),
        F.lit("Married"),
        F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.col("c_mktsegment")),
        F.concat(F.lit('"'), "o_orderpriority", F.lit('"')),
        F.when(F.col("o_orderstatus") == "F", "?").otherwise(F.col("o_orderstatus")),
        F.lit("Female"),
        F.floor("o_totalprice"),
        F.floor("c_acctbal"),
        F.lit(40),
        F.when(F.col("n_name") == "NATION_3", "?").otherwise(F.col("n_name")),
        F.col("o_orderstatus"),
    ]
    path = fresh_path(spark, "census")
    t.select(F.concat_ws(", ", *[f.cast("string") for f in whole]).alias("value")).write.text(path)
    return census.read_census(spark, path, mode="reader")


# Chat rooms and issue threads: a conversation is one or more files of a bounded number of turns.
PAGE = 256  # turns
WIDE = 16 * 1024  # bytes of a turn that many can have


def conversations(spark, sf) -> DataFrame:
    return i.table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])


def turn_bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0))


@query(
    "rooms_json",
    """SELECT 'room' || conv_id AS room, replace(text, chr(10), ' ') AS text, role AS name, turn
FROM conversations WHERE role <> 'system'""",
)
def rooms_json(spark, sf):
    """Messages with a field beyond the named ones, which the whole object keeps."""
    found = messages.parse_rooms(room_files(spark, sf))
    turn = F.variant_get("object", "$.turn", "long")
    line = F.regexp_replace("text", "\n", " ")
    return found.select("room", line.alias("text"), F.col("from.name").alias("name"), turn.alias("turn"))


def room_files(spark, sf) -> DataFrame:
    """``(path, value)``: at most ``PAGE`` messages of a room that are read together, a wide one alone."""
    message = F.struct(
        "turn",
        F.when(F.col("role") != "system", F.col("text")).alias("message"),
        F.struct(F.col("role").alias("name")).alias("from"),
    )
    rows = conversations(spark, sf).withColumn("row", F.monotonically_increasing_id())
    page = F.when(turn_bytes() <= WIDE, F.floor(F.col("row") / PAGE)).otherwise(-1 - F.col("row"))
    files = rows.withColumn("page", page).groupBy("conv_id", "page").agg(
        F.to_json(F.array_sort(F.collect_list(message))).alias("value")
    )
    path = F.concat(F.lit("/rooms/%23room%20"), "conv_id", F.lit("/day.json")).alias("path")
    return files.select(path, "value")


THREADS = """c AS (
  SELECT conv_id AS thread, text AS body, turn, role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position,
    CASE WHEN role <> 'assistant' THEN role END AS label FROM conversations)"""


def issue_threads(spark, sf) -> DataFrame:
    """Comments of issue files: a thread has its opening issue last, only some comments have labels."""
    return messages.parse_issue_threads(issue_files(spark, sf))


def issue_files(spark, sf) -> DataFrame:
    """``(path, first, value)``: consecutive comments of a thread, at most ``PAGE`` and fewer if wide.

    The comments are numbered by a sort in ranges, so no task has a whole thread.
    """
    label = F.when(F.col("role") != "assistant", F.array(F.struct(F.col("role").alias("name"))))
    comment = F.struct(F.col("text").alias("body"), label.alias("labels"), F.col("role").alias("author"))
    rows = conversations(spark, sf).withColumn("thread", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = ["thread", F.col("turn").desc_nulls_last(), "text", "role"]
    numbered = skew.dense_index(rows, order)
    sizes = numbered.groupBy("thread").agg(F.min("idx").alias("start"), F.max(turn_bytes()).alias("widest"))
    placed = skew.lookup_join(numbered, written(sizes, "threads"), "thread")
    place = F.col("idx") - F.col("start")
    size = F.greatest(F.lit(1), F.least(F.lit(PAGE), F.floor(F.lit(PAGE * WIDE) / F.greatest("widest", F.lit(1)))))
    pages = placed.withColumn("place", place).withColumn("page", F.floor(F.col("place") / size))
    ordered = F.array_sort(F.collect_list(F.struct("place", comment.alias("c"))))
    files = pages.groupBy("thread", "page").agg(
        F.to_json(F.transform(ordered, lambda x: x["c"])).alias("value"), F.min("place").alias("first")
    )
    path = F.concat(F.lit("/issues/"), F.nullif("thread", F.lit("")), F.lit(".txt")).alias("path")
    return files.select(path, "first", "value")


@query("issue_threads", f"WITH {THREADS} SELECT thread, position, body AS text, label, role AS author FROM c")
def issue_threads_query(spark, sf):
    found = issue_threads(spark, sf)
    label = F.get("labels.name", F.lit(0)).alias("label")
    author = F.variant_get("object", "$.author", "string").alias("author")
    return found.select("thread", "position", "text", label, author)


TALKS = """c AS (
  SELECT conv_id, turn, role, text, CASE WHEN role <> 'assistant' THEN role END AS label FROM conversations),
r AS (SELECT conv_id, arg_min(coalesce(label, ''), turn) AS root, count(*) AS n FROM c GROUP BY conv_id),
m AS (SELECT conv_id, turn, text, coalesce(label, nullif(root, '')) AS label FROM c JOIN r USING (conv_id))"""


def talks(spark, sf) -> DataFrame:
    """Conversations as threads: the lowest turn opens, answers have no label of their own."""
    label = F.when(F.col("role") != "assistant", F.col("role"))
    return conversations(spark, sf).select("conv_id", "turn", "text", label.alias("label"))


def inherited(spark, sf) -> DataFrame:
    return threads.inherit_from_root(talks(spark, sf), "conv_id", "turn", ["label"])


@query("thread_inherit", f"WITH {TALKS} SELECT conv_id, turn, text, label FROM m")
def thread_inherit(spark, sf):
    return inherited(spark, sf)


@query(
    "thread_nested",
    f"""WITH {TALKS} SELECT conv_id, any_value(r.n) AS messages,
  any_value(o.text) AS opening, arg_min(m.text, m.turn) AS first, arg_max(m.text, m.turn) AS last,
  count(*) AS comments, count(label) AS labelled
FROM m JOIN r USING (conv_id)
  JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM c GROUP BY conv_id) o USING (conv_id)
GROUP BY conv_id""",
)
def thread_nested(spark, sf):
    nested = threads.collect_thread(inherited(spark, sf), "conv_id", "turn", ["text", "label"])
    comments = F.col("comments")
    return nested.select(
        "conv_id",
        "messages",
        F.col("original_request.text").alias("opening"),
        F.get(comments, F.lit(0))["text"].alias("first"),
        F.element_at(comments, -1)["text"].alias("last"),
        F.size(comments).cast("long").alias("comments"),
        F.size(F.filter(comments, lambda c: c["label"].isNotNull())).cast("long").alias("labelled"),
    )


@query(
    "thread_rows",
    """SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS opens, text, role FROM conversations""",
)
def thread_rows(spark, sf):
    return threads.thread_rows(conversations(spark, sf), "conv_id", "turn", ["text", "role"])


# Scans, filters, splits, unions


@query("scan_project", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_project(spark, sf):
    where = (F.col("lang") == "en") & (F.col("n_chars") > 1000)
    fields = ["doc_id", "lang", "n_chars"]
    return rows.project_fields(tables.read_documents(spark, f"{sf}/documents.parquet", None, where), fields)


def line_unit_sql() -> str:
    return i.unit_sql("l_orderkey || ':' || l_linenumber")


@query(
    "random_scan",
    f"""SELECT l_orderkey, l_linenumber, round({line_unit_sql()}, 9) AS score FROM lineitem
WHERE {line_unit_sql()} >= 0.999""",
)
def random_scan(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    found = rows.random_scan(i.table(spark, sf, "lineitem", keys), keys, 0.999, i.SEED)
    return found.withColumn("score", F.round("score", 9))


@query(
    "must_not_filter",
    """WITH f AS (
  SELECT doc_id, CASE WHEN lang <> 'de' THEN lang <> 'en' END AS disambiguation, n_chars < 200 AS redirect
  FROM documents)
SELECT * FROM f WHERE NOT coalesce(disambiguation, false) AND NOT coalesce(redirect, false)""",
)
def must_not_filter(spark, sf):
    flags = i.table(spark, sf, "documents", ["doc_id", "lang", "n_chars"]).select(
        "doc_id",
        F.when(F.col("lang") != "de", F.col("lang") != "en").alias("disambiguation"),
        (F.col("n_chars") < 200).alias("redirect"),
    )
    return rows.exclude_flags(flags, ["disambiguation", "redirect"])


@query(
    "hash_split",
    f"""SELECT doc_id, CASE WHEN {i.unit_sql('doc_id')} < 0.6 THEN 'train' ELSE 'test' END AS part
FROM documents""",
)
def hash_split(spark, sf):
    train, test = rows.hash_split(i.table(spark, sf, "documents", ["doc_id"]), i.WEIGHTS, ["doc_id"], i.SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "union_corpora",
    """SELECT 'documents' AS corpus, doc_id AS id, length(text) AS n FROM documents
UNION ALL SELECT 'benchmark', item_id, length(text) FROM benchmark
UNION ALL SELECT 'conversations', conv_id, length(text) FROM conversations""",
)
def union_corpora(spark, sf):
    parts = [
        i.table(spark, sf, name, [key, "text"]).select(
            F.lit(name).alias("corpus"), F.col(key).alias("id"), F.length("text").cast("long").alias("n")
        )
        for name, key in (("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id"))
    ]
    return rows.union_labelled(parts)


@query("peek", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 2")
def peek(spark, sf):
    return rows.sample_rows(i.table(spark, sf, "documents", ["doc_id", "lang", "n_chars"]), 2, ["doc_id"])


@query("count_documents", "SELECT count(*) AS total FROM documents")
def count_documents(spark, sf):
    return rows.count_documents(i.table(spark, sf, "documents"))


@query(
    "terms_agg",
    "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10",
)
def terms_agg(spark, sf):
    return score.top_terms(i.table(spark, sf, "documents", ["source"]), "source", 10)


@query("keyword", "SELECT event_id, [event_type] AS tokens FROM events")
def keyword_query(spark, sf):
    """Whole values as their only tokens."""
    return i.table(spark, sf, "events", ["event_id", "event_type"]).select(
        "event_id", keyword("event_type").alias("tokens")
    )


# Writers


@query("write_roundtrip", f"WITH {i.LABELS} SELECT doc_id, label, text FROM documents JOIN lab USING (doc_id)")
def write_roundtrip(spark, sf):
    path, docs = fresh_path(spark, "documents"), i.labelled(spark, sf)
    tables.write_documents(docs.where(F.col("label") == "positive"), path)
    tables.write_documents(docs.where(F.col("label") == "negative"), path, "append")
    return tables.read_documents(spark, path, ["doc_id", "label", "text"])


@query(
    "variant_roundtrip",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, NULL::VARCHAR AS airport
FROM events
UNION ALL SELECT c_custkey, NULL, c_name FROM customer""",
)
def variant_roundtrip(spark, sf):
    """Documents with different keys in one table, written to two targets."""
    events = i.table(spark, sf, "events", ["event_id", "props"])
    named = i.table(spark, sf, "customer", ["c_custkey", "c_name"]).select(
        F.col("c_custkey").alias("event_id"),
        F.to_json(F.struct(F.col("c_name").alias("airport"))).alias("props"),
    )
    paths = [fresh_path(spark, "variants"), fresh_path(spark, "variants")]
    tables.write_variant_docs(events.unionByName(named), "props", paths)
    return tables.read_documents(spark, paths[1]).select(
        "event_id",
        tables.variant_field("doc", "k", "int").alias("k"),
        tables.variant_field("doc", "airport", "string").alias("airport"),
    )


@query(
    "new_ids",
    """SELECT user_id, event_type, count(*) AS n, count(*) AS ids FROM events GROUP BY ALL""",
)
def new_ids(spark, sf):
    """Rows without an id get one when they are appended; each id is there once."""
    path = fresh_path(spark, "events")
    tables.write_documents(tables.with_new_ids(i.table(spark, sf, "events", ["user_id", "event_type"])), path)
    stored = tables.read_documents(spark, path)
    return stored.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids")
    )


@query(
    "upsert_by_key",
    """WITH n AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal
  FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)
UNION ALL SELECT c_custkey, c_acctbal FROM n""",
)
def upsert_by_key(spark, sf):
    customers = i.table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    changes = i.table(spark, sf, "orders", ["o_custkey", "o_totalprice", "o_orderkey"]).select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey"
    )
    return tables.upsert_documents(customers, changes, "c_custkey", version="o_orderkey")


@query(
    "upsert_bucketed",
    """WITH n AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS c_acctbal
  FROM orders WHERE o_custkey % 50 < 2 GROUP BY o_custkey)
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)
UNION ALL SELECT c_custkey, c_acctbal FROM n""",
)
def upsert_bucketed(spark, sf):
    """Changes of some customers, replaced in a stored table whose other buckets are not touched."""
    path = fresh_path(spark, "customers")
    tables.write_bucketed(i.table(spark, sf, "customer", ["c_custkey", "c_acctbal"]), path, "c_custkey", 64)
    orders = i.table(spark, sf, "orders", ["o_custkey", "o_totalprice", "o_orderkey"]).where("o_custkey % 50 < 2")
    changes = orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    tables.upsert_bucketed(spark, path, changes, "c_custkey", 64, version="o_orderkey")
    return spark.read.parquet(path).select("c_custkey", "c_acctbal")
