import random
import re

import pytest
from pyspark.sql import functions as F

from labelkite.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    """Words, hit words and items of each document, by comparing word lists."""
    cut = {i: WORD.findall((t or "").translate(LOWER)) for i, t in items}
    out = []
    for i, t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for item, w in cut.items():
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        out.append((i, len(words), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    words = ["ab", "Çé", "c3", "dd", "日本"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14)))) for i in range(20)]
    items += [(30, None), (31, "..."), (32, items[3][1]), (33, "one Two three")]
    docs = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    docs += [(i + 100, f"Start {t} end; {t}" if t else t) for i, t in items]
    docs += [(200, None), (201, ""), (202, "say ONE two-three, one"), (203, "one two")]
    return docs, items


def frames(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(tables[1], "item_id long, text string")


@pytest.mark.parametrize("block", [D.BLOCK, 10])
def test_hits_equal_brute_force(spark, tables, block):
    docs, items = frames(spark, tables)
    windows = D.benchmark_windows(items)
    assert block == D.BLOCK or windows.count() > 2 * block
    got = D.hits(docs, windows, block=block).collect()
    found = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in got]
    assert sorted(found, key=repr) == brute(*tables)


@pytest.mark.parametrize("block", [D.BLOCK, 10])
def test_removal(spark, tables, block):
    docs, items = frames(spark, tables)
    docs = docs.withColumn("found", F.lit(1)).withColumn("more", F.lit(2))
    windows = D.benchmark_windows(items)
    dirty = {i for i, _, n, _ in brute(*tables) if n}
    kept = D.decontaminate(docs, windows, block=block)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in tables[0]} - dirty
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, windows, "spans", block=block).collect()}
    assert len(cut) == len(tables[0])
    for i, t in tables[0]:
        assert (cut[i] == t) if i not in dirty else len(cut[i]) < len(t)
    assert cut[202] == "say , one"
    with pytest.raises(ValueError):
        D.decontaminate(docs, windows, "words")


def test_nothing(spark, tables, no_documents):
    docs, items = frames(spark, tables)
    empty = D.benchmark_windows(items.where("false"))
    assert D.hits(docs, empty).where("n_hit > 0").count() == 0
    assert D.decontaminate(docs, empty).count() == len(tables[0])
    assert D.hits(no_documents, D.benchmark_windows(items)).count() == 0
    nameless = D.benchmark_windows(items.withColumn("item_id", F.lit(None).cast("long")))
    assert nameless.count() == 0


@pytest.mark.parametrize("block", [D.BLOCK, 1])
def test_items_without_an_id_hit(spark, block):
    items = [(None, "one two three"), (None, "four five"), (7, "four five"), (8, "six")]
    docs = [(1, "say One two, three!"), (2, "four five six"), (3, "one two"), (4, "one two three four five")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    windows = D.benchmark_windows(spark.createDataFrame(items, "item_id long, text string"), unnamed=True)
    got = D.hits(docs, windows, block=block).select("doc_id", "n_hit", "items", "n_items").collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, [], 1), (2, 3, [7, 8], 3), (3, 0, [], 0), (4, 5, [7], 2)]
    assert [r["doc_id"] for r in D.decontaminate(docs, windows, block=block).collect()] == [3]


def test_query_and_pipeline_keep_items_without_an_id(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(14))
    items = [(None, long), (None, "four five"), (7, "four five"), (8, "six"), (9, None)]
    docs = [(1, f"say {long}."), (2, "four five six"), (3, "one two"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["op7_decontamination"]).fetchall()
    got = entry.queries()["op7_decontamination"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert sorted(r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()) == [3, 4]
