import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from labelkite.llm import exact_dedup as X

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(SPACE.sub(" ", text or "").encode()).digest()


def groups(rows):
    """Brute force: digest to (smallest id, number of rows)."""
    found = defaultdict(list)
    for i, t in rows:
        found[digest(t)].append(i)
    return {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in found.items()}


def live(index):
    return {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in X.entries(index).collect()}


def test_groups_of_odd_documents(odd_documents, odd_texts):
    got = X.groups_of(X.digests(odd_documents)).collect()
    want = groups([(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert len(got) == len(odd_texts)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[bytes(r["digest"])]


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = X.groups_of(X.digests(docs)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in got) == [
        (False, 3, 3, 2), (False, 4, 3, 2), (False, 5, 5, 3), (False, 5, 5, 3),
        (True, 0, 0, 2), (True, 0, 0, 2), (True, 0, 5, 3),
    ]
    kept = X.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "5", "5", "None", "None"]


def test_no_documents(no_documents):
    assert X.groups_of(X.digests(no_documents)).count() == 0
    assert X.deduplicate(no_documents).count() == 0


def test_insert_and_delete(spark):
    first = [(i, f"t{i % 40}") for i in range(100)]
    more = [(i, f"t{i % 70}") for i in range(100, 160)]
    keyed = [X.digests(spark.createDataFrame(r, "doc_id long, text string")) for r in (first, more)]
    index = X.insert(X.build(keyed[0]), keyed[1])
    assert live(index) == groups(first + more)
    gone = set(range(0, 160, 2)) | {1, 41, 81}
    both = keyed[0].unionByName(keyed[1])
    left = X.delete(index, both, spark.createDataFrame([(i,) for i in gone], "id long"))
    assert live(left) == groups([r for r in first + more if r[0] not in gone])
    again = X.insert(left, keyed[1].where("doc_id % 2 = 0"))
    assert live(again) == groups([r for r in first + more if r[0] not in gone] + [r for r in more if r[0] % 2 == 0])


def test_filter_grows_and_forgets():
    shard = X.Shard()
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5_000)]
    for i, d in enumerate(digests):
        shard.add(d, i, 1)
    assert shard.filter.buckets > X.FIRST_BUCKETS
    assert all(shard.find(d)[1] == i for i, d in enumerate(digests))
    for d in digests[::2]:
        shard.set(d, None, 0)
    assert [shard.find(d) is None for d in digests] == [i % 2 == 0 for i in range(5_000)]
    false = sum(shard.filter.contains(hashlib.sha256(f"x{i}".encode()).digest()) for i in range(5_000))
    assert false < 20  # and none of them is taken for a known text:
    assert all(shard.find(hashlib.sha256(f"x{i}".encode()).digest()) is None for i in range(5_000))


def test_equal_marks_do_not_merge_texts():
    shard = X.Shard()
    a, b = b"\x01\x00" + bytes(30), b"\x01\x00" + bytes(29) + b"\x01"
    shard.add(a, 1, 1)
    assert shard.filter.contains(b) and shard.find(b) is None
    shard.add(b, 2, 1)
    assert sorted(e[1] for e in shard.entries()) == [1, 2]


def test_hot_text_sends_few_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    keyed = X.digests(docs)
    assert X._adds(keyed, 4).count() <= 30_000 // 10_000 + keyed.rdd.getNumPartitions()
    assert live(X.build(keyed)) == {digest("same"): (0, 30_000)}


@pytest.mark.parametrize("shards", [1, 9])
def test_number_of_shards_changes_nothing(odd_documents, shards):
    keyed = X.digests(odd_documents)
    assert live(X.build(keyed, shards)) == groups([(r["doc_id"], r["text"]) for r in odd_documents.collect()])
