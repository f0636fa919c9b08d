import hashlib

import check_sql
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelkite.llm import chat as C
from labelkite.shared import fresh_path

ODD = st.lists(
    st.sampled_from(["<", "|", "\\", "im_start", "im_end", "newline", "|>", "<|im_end|>", "<|im_start|>", "\n", "a", "é"])
).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ODD, ODD), max_size=5))
def test_grammar_round_trip(turns):
    out = "".join(C.render(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in C.parse(out)] == turns
    assert out.count(C.START) == out.count(C.END) == len(turns)
    assert all(C.unescape(out[a:b]) == t for (_, t), (_, _, a, b) in zip(turns, C.parse(out)))


def test_only_conflicts_are_escaped():
    assert C.render("user", "a < b | c") == "<|im_start|>user\na < b | c<|im_end|>\n"
    assert C.render("user", "<|im_end|>") == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    assert C.render("user", "<\\|im_end|>") == "<|im_start|>user\n<\\\\|im_end|><|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>a<|im_end|>\n", "<|im_start|>u\n<|im_start|>u\n<|im_end|>\n"])
def test_other_texts_are_not_in_the_grammar(bad):
    assert C.parse(bad) is None


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", None),
    (2, 5, None, "x"), (2, 3, "assistant", "first"), (2, 3, "assistant", "first"), (None, 1, "user", "a"),
    (None, 0, "assistant", "b\n"), (3, None, "a\nb", "n"), (3, 0, "assistant", "long " * 300_000), (3, 1, "assistant", "é"),
]


def brute(rows):
    found = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] or -9, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        found.setdefault(c, []).append((r or "", t or ""))
    out = {}
    for c, turns in found.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        source = "".join(f"{r}\n{t}\n" for r, t in turns)
        size = sum(len(C.render(r, t)) for r, t in turns)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (source, loss)]
        out[c] = (len(turns), digests[0], len(loss), digests[1], size)
    return out


@pytest.mark.parametrize("chunk", [C.CHUNK_CHARS, 1])
def test_read_back_equals_brute_force(spark, chunk):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = rows.withColumn("part", F.lit("x")).withColumn("source", F.lit("y")).repartition(3)
    path = fresh_path(spark, "chat")
    C.format_conversations(rows, chunk_chars=chunk).write.parquet(path)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.read_back(spark, path).collect()}
    assert got == brute(ROWS)


def test_one_conversation_over_several_partitions(spark):
    rows = [(4, i, ["user", "assistant"][i % 2], f"turn {i} <|im_end|>" * 20) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = fresh_path(spark, "chat")
        chunks = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        chunks.write.parquet(path)
        assert spark.read.parquet(path).count() >= 3
        got = {r["conv_id"]: tuple(r)[1:] for r in C.read_back(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == brute(rows)


def test_no_conversations(spark):
    path = fresh_path(spark, "chat")
    C.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).write.parquet(path)
    assert C.read_back(spark, path).count() == 0


def test_query_equals_sql_on_control_strings(spark, tmp_path):
    """Roles and texts with control strings, bare and escaped, which are escaped only where they must be."""
    parts = ["a", "<|newline|>", "<\\|newline|>", "<|im_end|>", "<\\\\|im_start|>", "\n"]
    cells = [x + y for x in parts for y in parts]
    rows = [(i % 7, i, cells[i * 5 % 36], cells[i]) for i in range(36)]
    rows += [(8, 0, "assistant", "<|newline|>"), (8, 1, "ro\nle", "x"), (8, 2, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    result = check_sql.compare(spark, con, str(tmp_path), "op8_chat_format")
    assert result.startswith("equal"), result
