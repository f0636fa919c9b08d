import json

import pytest
from pyspark.sql import functions as F

from labelkite.operators import rows as row_ops
from labelkite.operators import threads
from labelkite.plans import source_queries
from labelkite.shared import fresh_path
from labelkite.sources import census, labelled, messages, tables


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_labelled_dirs(spark, rows, tmp_path):
    pos = put(tmp_path / "pos", a__txt='good "film"\nyes\\', b__txt="fine")
    neg = put(tmp_path / "neg", a__txt="bad é")
    got = labelled.read_labelled_dirs(spark, {"positive": [pos], "negative": neg})
    assert rows(got, "label", "text") == [
        ("negative", "bad é"), ("positive", "fine"), ("positive", "good  film  yes ")
    ]


def test_sequential_docs(spark, tmp_path):
    pos = put(tmp_path / "pos", b__txt="two", c__txt="three")
    put(tmp_path / "pos" / "a", z__txt="one é\x01")
    neg = put(tmp_path / "neg", a__txt="four")
    got = labelled.read_sequential_docs(spark, {"pos": pos, "neg": neg}).orderBy("id").collect()
    assert [(r["id"], r["text"], r["class"]) for r in got] == [
        (1, "one ", "pos"), (2, "two", "pos"), (3, "three", "pos"), (4, "four", "neg")
    ]


def test_polarity_csv(spark, tmp_path):
    lines = ['"4","1","d","q","u","hello, world"', '"0", "1","d","q","u",  "sad"', '"4","1"']
    path = put(tmp_path / "t", f__csv="\n".join(lines))
    got = [tuple(r) for r in labelled.read_polarity_csv(spark, path).collect()]
    assert got == [("positive", '"hello'), ("negative", '"sad"'), ("positive", "")]
    path = put(tmp_path / "u", f__csv=lines[0] + "\n" + '"0","1","d","q","u","say ""hi"""')
    got = [tuple(r) for r in labelled.read_polarity_csv(spark, path, mode="csv").collect()]
    assert got == [("positive", "hello, world"), ("negative", 'say "hi"')]


GOOD = "39, State-gov, 77516, Bachelors, 13, Never-married, ?, Not-in-family, ?, Male, 2174, 0, 40, ?, <=50K"


def test_census_loader(spark, tmp_path):
    lines = [GOOD, "", "x, ?, 1.5, a, , b, c, d, e, f, none, 1, 2e1, g, >50K", "1, 2", GOOD[: -len(" <=50K")]]
    path = put(tmp_path / "c", f__data="\n".join(lines) + "\n")
    got = census.read_census(spark, path).collect()
    assert got[0].asDict() == dict(
        age=39, workclass="State-gov", fnlwgt=77516, education="Bachelors", education_num=13,
        marital_status="Never-married", occupation="", relationship="Not-in-family", race="?", sex="Male",
        capital_gain=2174.0, capital_loss=0.0, hours_per_week=40.0, native_country="", label="<=50K",
    )
    assert set(got[1]) == {None} and set(got[3]) == {None} and set(got[4]) == {None}
    odd = got[2]
    assert (odd["age"], odd["workclass"], odd["fnlwgt"], odd["education_num"]) == (None, "", None, None)
    assert (odd["capital_gain"], odd["hours_per_week"]) == (None, 20.0)
    path = put(tmp_path / "bad", f__data=GOOD.replace(" 0, 40", " zero, 40"))
    with pytest.raises(Exception, match="capital_loss"):
        census.read_census(spark, path).collect()


def test_census_reader(spark, tmp_path):
    quoted = GOOD.replace("State-gov", "'State-gov'").replace("Bachelors", '"Bachelors"')
    path = put(tmp_path / "c", f__data=quoted + "\n\n" + GOOD + "\n")
    got = census.read_census(spark, path, mode="reader").collect()
    assert len(got) == 2
    assert (got[0]["workclass"], got[0]["education"], got[0]["race"]) == ("State-gov", "Bachelors", None)
    assert got[0]["occupation"] is None and got[0]["capital_gain"] == 2174
    inner = GOOD.replace("State-gov", "'State, local'").replace("Bachelors", '"B, \'A\'"')
    path = put(tmp_path / "d", f__data=inner + "\n")
    got = census.read_census(spark, path, mode="reader").first()
    assert (got["workclass"], got["education"], got["education_num"], got["label"]) == ("State, local", "B, 'A'", 13, "<=50K")
    path = put(tmp_path / "e", f__data=GOOD.replace("39,", "?,") + "\n")
    with pytest.raises(Exception, match="age"):
        census.read_census(spark, path, mode="reader").collect()
    path = put(tmp_path / "short", f__data="1, 2\n")
    with pytest.raises(Exception):
        census.read_census(spark, path, mode="reader").collect()


def test_rooms(spark, rows, tmp_path):
    talk = [
        {"message": "hi\nall", "from": {"name": "Ann", "user_id": 7}},
        {"from": {"name": "Bob"}},
        {"message": "bye", "from": {"name": "Bob", "user_id": "api"}, "more": 1},
    ]
    put(tmp_path / "rooms" / "#Big Room", day__json=json.dumps(talk).replace("\\n", "\n"))
    put(tmp_path / "rooms" / "other", day__json="[{not json", notes__txt='[{"message": "no"}]')
    got = messages.read_rooms(spark, str(tmp_path / "rooms"))
    got = got.withColumn("name", F.col("from.name")).withColumn("user", F.col("from.user_id"))
    assert rows(got, "room", "text", "name", "user") == [
        ("BigRoom", "bye", "Bob", "api"), ("BigRoom", "hi all", "Ann", "7")
    ]
    more = got.select(F.try_variant_get("object", "$.more", "int").alias("more"))
    assert sorted(r["more"] or 0 for r in more.collect()) == [0, 1]


@pytest.fixture(scope="module")
def hot_conversation(spark, tmp_path_factory):
    """A folder with a conversation of 150 MB, which is more than a VARIANT holds, and a small one."""
    path = str(tmp_path_factory.mktemp("hot"))
    rows = spark.range(3500).select(
        F.when(F.col("id") < 3490, 1).otherwise(2).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") < 1500, F.expr("repeat('x', 100000)")).otherwise(F.lit("short")).alias("text"),
    )
    rows.repartition(3, "turn").write.parquet(f"{path}/conversations.parquet")
    return path


def test_a_hot_room_is_whole(spark, hot_conversation):
    found = source_queries.rooms_json(spark, hot_conversation).groupBy("room").agg(
        F.count("*"), F.count_distinct("turn"), F.sum(F.length("text"))
    )
    assert sorted(tuple(r) for r in found.collect()) == [
        ("room1", 3490, 3490, 150_000_000 + 1990 * 5), ("room2", 10, 10, 50)
    ]
    largest = source_queries.room_files(spark, hot_conversation).agg(F.max(F.octet_length("value"))).first()[0]
    assert largest < messages.LARGE


def test_a_hot_thread_is_whole(spark, hot_conversation):
    found = source_queries.issue_threads_query(spark, hot_conversation)
    n = F.when(F.col("thread") == 1, 3490).otherwise(10)
    want_role = F.when((n - F.col("position")) % 2 == 1, "user").otherwise("assistant")
    got = found.groupBy("thread").agg(
        F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position"),
        F.sum(F.length("text")), F.count_if(F.col("author") == want_role),
    )
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 3490, 3490, 0, 3489, 150_000_000 + 1990 * 5, 3490), (2, 10, 10, 0, 9, 50, 10)
    ]
    largest = source_queries.issue_files(spark, hot_conversation).agg(F.max(F.octet_length("value"))).first()[0]
    assert largest < messages.LARGE


def test_a_thread_in_several_rows(spark, rows):
    parts = [("/i/4.txt", 2, '[{"body": "c"}, {"body": "open"}]'), ("/i/4.txt", 0, '[{"body": "a"}, {"body": "b"}]')]
    files = spark.createDataFrame(parts, "path string, first long, value string")
    got = rows(messages.parse_issue_threads(files), "thread", "position", "text")
    assert got == [(4, 0, "a"), (4, 1, "b"), (4, 2, "c"), (4, 3, "open")]


def test_a_room_too_large_for_one_row_stops(spark):
    texts = F.array_join(F.array_repeat(F.expr("""concat('{"message":"', repeat('x', 1048576), '"}')"""), F.col("id").cast("int")), ",")
    file = F.concat(F.lit("["), texts, F.lit("]"))
    one = spark.range(140, 141).select(F.lit("/a/r/f.json").alias("path"), file.alias("value"))
    with pytest.raises(Exception, match="several arrays"):
        messages.parse_rooms(one).select("room").collect()
    broken = spark.range(20, 21).select(F.lit("/a/r/f.json").alias("path"), F.concat(file, F.lit("]x")).alias("value"))
    fine = spark.range(20, 21).select(F.lit("/a/r/f.json").alias("path"), file.alias("value"))
    assert messages.parse_rooms(fine).count() == 20
    assert messages.parse_rooms(broken.select("path", F.expr("replace(value, '[', '{')").alias("value"))).count() == 0


def issues(tmp_path):
    bug, doc = [{"name": "bug"}], [{"name": "doc"}, {"name": "x"}]
    first = [{"body": "c1"}, {"body": "c2", "labels": doc}, {"body": "open", "labels": bug}]
    return put(
        tmp_path / "issues",
        **{"12__txt": json.dumps(first), "7__txt": json.dumps([{"body": "a"}, {"body": "b"}])},
    )


def test_issue_threads(spark, rows, tmp_path):
    flat = messages.read_issue_threads(spark, issues(tmp_path))
    assert flat.columns == ["thread", "position", "text", "body", "labels", "object"]
    full = threads.inherit_from_root(flat, "thread", "position", ["labels"], root="last")
    names = full.withColumn("l", F.concat_ws("+", "labels.name")).withColumn("none", F.col("labels").isNull())
    assert rows(names, "thread", "position", "text", "l", "none") == [
        (12, 0, "c1", "bug", False), (12, 1, "c2", "doc+x", False), (12, 2, "open", "bug", False),
        (7, 0, "a", "", True), (7, 1, "b", "", True),
    ]
    whole = threads.collect_thread(full, "thread", "position", ["body", "labels"], root="last")
    got = {r["thread"]: r for r in whole.collect()}
    assert got[12]["original_request"]["body"] == "open" and got[12]["messages"] == 3
    assert [c["body"] for c in got[12]["comments"]] == ["c1", "c2", "open"]
    with pytest.raises(Exception, match="too many messages"):
        threads.collect_thread(full, "thread", "position", ["body"], root="last", max_messages=2).collect()
    long = threads.thread_rows(full, "thread", "position", ["body"], root="last")
    assert rows(long.where("opens"), "thread", "body") == [(12, "open"), (7, "b")]
    assert long.count() == 5
    path = put(tmp_path / "bad", **{"3__txt": "[{"})
    with pytest.raises(Exception):
        messages.read_issue_threads(spark, path).collect()


def test_tables(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5).select("id", F.lit("a").alias("s"))
    tables.bulk_write([df, df], path)
    assert tables.read_documents(spark, path).count() == 10
    tables.write_documents(df, path)
    assert tables.read_documents(spark, path, ["id"], "id > 2").count() == 2
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (9, "d", 1)], "id long, s string, v int")
    got = tables.upsert_documents(df, new, "id", version="v")
    assert rows(got, "id", "s") == [(0, "a"), (1, "c"), (2, "a"), (3, "a"), (4, "a"), (9, "d")]
    twice = spark.createDataFrame([(1, "b"), (1, "c"), (7, "d"), (7, "d")], "id long, s string")
    again = [rows(tables.upsert_documents(df, twice.orderBy("s", ascending=a), "id"), "id", "s") for a in (True, False)]
    assert again[0] == again[1] and [i for i, _ in again[0]] == [0, 1, 2, 3, 4, 7]
    assert tables.with_new_ids(df, "key").select("key").distinct().count() == 5


def test_variant_documents(spark, tmp_path):
    # Two documents without a common key.
    docs = ['{"one":1,"two":2}', '{"OTP":"Otopeni","SFO":"San Fran"}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, body string")
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    tables.write_variant_docs(df, "body", paths)
    for path in paths:
        got = tables.read_documents(spark, path).select(
            "id", tables.variant_field("doc", "two", "int"), tables.variant_field("doc", "SFO", "string")
        )
        assert sorted(tuple(r) for r in got.collect()) == [(0, 2, None), (1, None, "San Fran")]


def test_row_operators(spark, rows):
    df = spark.createDataFrame(
        [(1, None, False, ["a"]), (2, True, False, []), (3, False, True, ["b"]), (4, False, None, [])],
        "id long, x boolean, y boolean, tokens array<string>",
    )
    assert rows(row_ops.exclude_flags(df, ["x", "y"]), "id") == [(1,), (4,)]
    assert rows(row_ops.drop_empty_vectors(df), "id") == [(1,), (3,)]
    assert row_ops.drop_empty_vectors(df, keep_empty=True).count() == 4
    assert row_ops.keep_columns(df, ["id", "x", "y"], ["x"]).columns == ["id", "y"]
    many = spark.range(5000)
    train, test = row_ops.hash_split(many, [6, 4], ["id"], 3)
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    assert 2800 < train.count() < 3200
    other = row_ops.hash_split(many, [6, 4], ["id"], 4)[0]
    assert rows(train, "id") != rows(other, "id")
    assert row_ops.random_scan(many, ["id"], 0.9).where("score >= 0.9").count() in range(400, 600)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_bucketed_upsert_rewrites_only_what_changed(spark, tmp_path):
    rows = [(i, f"old {i}") for i in range(400)] + [(None, "no key")]
    path = str(tmp_path / "table")
    tables.write_bucketed(spark.createDataFrame(rows, "id long, text string"), path, "id", 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    changes = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (900, "new", 1)], "id long, text string, v long")
    touched = tables.upsert_bucketed(spark, path, changes, "id", 16, version="v")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    assert 1 <= len(touched) <= 2
    for p, t in before.items():
        number = int(p.parent.name.split("=")[1])
        assert (p in after and after[p] == t) == (number not in touched)
    got = {r["id"]: r["text"] for r in spark.read.parquet(path).collect()}
    assert got == {**dict(rows), 7: "b", 900: "new"}
    assert tables.upsert_bucketed(spark, path, changes.limit(0), "id", 16) == []
    plan = spark.read.parquet(path).where(F.col(tables.BUCKET).isin(touched))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or f"{tables.BUCKET}" in plan.split("PartitionFilters:")[1][:80]
