import zlib

import __spark_entry__ as entry
import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from check_sql import compare, connect
from tokenizers import Tokenizer

from labelkite.llm import queries, quality_crf
from test_decontaminate import brute as passages
from test_exact_dedup import digest
from test_jaccard_join import brute as groups
from test_tokens import checked, ids_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_one_query_for_each_operator():
    names = list(queries.registry.queries)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(names) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.registry.sql))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, SMALL, name)
    assert result.startswith("equal"), result


def rows_of(con, table, columns):
    return con.execute(f"SELECT {columns} FROM {table} ORDER BY 1").fetchall()


def test_token_store_query(spark, con):
    rows = rows_of(con, "documents", "doc_id, coalesce(text, '')")
    start, want = 0, []
    for (i, _), ids in zip(rows, ids_of("word_bpe_49k.json", [t for _, t in rows])):
        want.append((i, start, len(ids) + 1, zlib.crc32(np.array(ids + [1], "<u4").tobytes())))
        start += len(ids) + 1
    got = queries.op2_token_store(spark, SMALL)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_token_count_query(spark, con):
    rows = rows_of(con, "documents", "doc_id, coalesce(text, '')")
    n = map(len, ids_of("byte_bpe_50k.json", [t for _, t in rows]))
    want = [(i, len(t.encode()), k, k > 1024) for (i, t), k in zip(rows, n)]
    assert sorted(map(tuple, queries.op3_token_counts(spark, SMALL).collect())) == want


def test_packing_query(spark, con):
    got = queries.op4_packing(spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
    rows = rows_of(con, "documents", "doc_id, coalesce(text, '')")
    full = dict(zip([i for i, _ in rows], ids_of("byte_bpe_50k.json", [t for _, t in rows])))
    for r in got.collect():
        ids = np.array([*full[r["doc_id"]], 0], "<u4")[r["start"] :][: r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(full[r["doc_id"]]) + 1


@pytest.mark.parametrize("name,label,least", [("op5_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.85)])
def test_classifier_queries(spark, con, name, label, least):
    got = queries.registry.queries[name](spark, SMALL)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    truth = dict(rows_of(con, "labels", f"doc_id, {label}"))
    rows = got.collect()
    assert len(rows) == 200
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] in truth]) >= least


def test_similar_groups_query(spark, con):
    rows = rows_of(con, "documents", "doc_id, text")
    assert sorted(map(tuple, queries.op9_similar_groups(spark, SMALL).collect())) == groups(rows)[0]


def test_stages_against_brute_force(spark, con):
    """Each stage's rows follow from its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = rows_of(con, "benchmark", "item_id, text")

    def after(name, df):
        got = dict(P.STAGES)[name](spark, df, SMALL)
        assert got.columns == columns
        return spark.createDataFrame(got.collect(), docs.schema)

    def rows(df):
        return sorted((r["doc_id"], r["text"]) for r in df.collect())

    good = after("quality classifier", docs)
    field = quality_crf.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scores = docs.select("doc_id", quality_crf.score("text", field).alias("s")).collect()
    assert {i for i, _ in rows(good)} == {r["doc_id"] for r in scores if r["s"] >= 0.3}

    single = after("exact dedup", good)
    first = {}
    for i, t in rows(good):
        first.setdefault(digest(t), i)
    assert [i for i, _ in rows(single)] == sorted(first.values())

    apart = after("n-gram Jaccard join", single)
    want, _ = groups(rows(single), P.WORDS, P.SIMILARITY)
    assert [i for i, _ in rows(apart)] == [i for i, _, g in want if i == g]

    clean = after("benchmark decontamination", apart)
    assert [i for i, _ in rows(clean)] == sorted(i for i, _, n, _ in passages(rows(apart), items) if not n)

    full = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    ids = {i: [*full.encode(t or "", add_special_tokens=False).ids, P.END_ID] for i, t in rows(clean)}
    checked(dict(P.STAGES)["packing"](spark, clean, SMALL).collect(), ids, 1024)

    pieces = P.run(spark, SMALL)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(ids)
