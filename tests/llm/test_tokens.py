import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelkite.llm import bytehash, jaccard_join, packing, pieces, token_counts, token_store
from labelkite.llm.bytehash import slices, text_bytes
from labelkite.llm.elias_fano import EliasFano
from labelkite.shared import fresh_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, texts):
    return [e.ids for e in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(coder, texts, most=1 << 20):
    raw, borders = text_bytes(pa.array(texts, pa.string()))
    out = []
    for a, b in slices(borders, most):
        flat, n = coder.encode(raw[borders[a] : borders[b]], borders[a : b + 1] - borders[a])
        out += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    return out


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name, odd_texts):
    coder = pieces.PieceCoder(public_tokenizers.path(name))
    assert coder.rule in ("blank", "word")
    assert encoded(coder, odd_texts, 300) == ids_of(name, odd_texts)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t'aAsé1#.日 ́\x00Жẞ")) | st.characters(codec="utf-8")), max_size=8))
def test_ids_of_any_text(name, texts):
    if name not in test_ids_of_any_text.coders:
        test_ids_of_any_text.coders[name] = pieces.PieceCoder(public_tokenizers.path(name))
    if texts:
        assert encoded(test_ids_of_any_text.coders[name], texts) == ids_of(name, texts)


test_ids_of_any_text.coders = {}


def twins(letters="ab", doublings=11):
    """Two strings that sums of bytes times powers of one number cannot tell apart (Thue-Morse)."""
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("name", FILES)
def test_strings_that_powers_cannot_tell_apart(name):
    a, b = twins()
    assert len(a) == 2048
    coder = pieces.PieceCoder(public_tokenizers.path(name))
    texts = [a, b, f"x {b} {a}"]
    assert encoded(coder, texts) == ids_of(name, texts)
    raw, borders = text_bytes(pa.array(texts))
    sizes = pieces.PieceCoder(public_tokenizers.path(name), keep_ids=False).counts(raw, borders)
    assert sizes.tolist() == [len(x) for x in ids_of(name, texts)]
    words = [f"{x} {y} end" for x, y in ((a, b), (b, a), (a, a))]
    shingles, _ = jaccard_join.shingle_sets(*text_bytes(pa.array(words)))
    assert len(set(shingles.tolist())) == 3


@pytest.mark.parametrize("name", FILES)
def test_pieces_are_compared_by_their_bytes(monkeypatch, odd_texts, name):
    """Ids stay right when most pieces share a hash."""
    monkeypatch.setattr(bytehash, "mixed", lambda h: h % np.uint64(3))
    coder = pieces.PieceCoder(public_tokenizers.path(name))
    assert encoded(coder, odd_texts, 200) == ids_of(name, odd_texts)


def test_forgetting_changes_nothing(monkeypatch, odd_texts):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    coder = pieces.PieceCoder(public_tokenizers.path(FILES[0]))
    assert encoded(coder, odd_texts, 100) == ids_of(FILES[0], odd_texts)


def test_a_text_in_pieces_of_its_own(odd_texts):
    """An unknown rule is encoded whole."""
    coder = pieces.PieceCoder(public_tokenizers.path(FILES[0]))
    coder.rule = "whole"
    some = odd_texts[:40]
    assert encoded(coder, some) == ids_of(FILES[0], some)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=400))
def test_elias_fano_round_trip(steps):
    numbers = np.cumsum(np.array(steps, np.int64))
    code = EliasFano.of(numbers)
    assert code.all().tolist() == numbers.tolist()
    assert [code.select(i) for i in range(len(numbers))] == numbers.tolist()


def test_elias_fano_is_small():
    numbers = np.sort(np.random.default_rng(1).integers(0, 10_000_000, 10_000))
    code = EliasFano.of(numbers)
    bits = 8 * (len(code.low) + len(code.high) + len(code.samples))
    assert bits / len(numbers) < 2.5 + np.log2(1000)
    with pytest.raises(IndexError):
        code.select(10_000)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_store_round_trip(spark, odd_documents, block):
    path = fresh_path(spark, "store")
    words = public_tokenizers.path(FILES[1])
    docs = odd_documents.withColumn("ids", odd_documents.lang).withColumn("part", odd_documents.lang)
    token_store.write_store(docs, path, words, 1, block_ids=block)
    rows = sorted((r["doc_id"], r["text"]) for r in odd_documents.fillna("").collect())
    want, start = {}, 0
    for (i, _), ids in zip(rows, ids_of(FILES[1], [t for _, t in rows])):
        want[i] = (start, np.array(ids + [1], "<u4").tobytes())
        start += len(ids) + 1
    got = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in token_store.read_store(spark, path).collect()}
    assert got == want
    some = [rows[0][0], rows[77][0], rows[-1][0]]
    found = token_store.look_up(spark, path, [*some, 10**9]).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in found} == {i: want[i][1] for i in some}
    assert token_store.look_up(spark, path, []).count() == 0


def test_store_of_nulls_repeats_and_nothing(spark, no_documents):
    words = public_tokenizers.path(FILES[1])
    docs = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a"), (1, None)], "doc_id long, text string")
    path = fresh_path(spark, "store")
    token_store.write_store(docs, path, words, 1)
    got = token_store.read_store(spark, path).collect()
    assert [(r["doc_id"], r["start"]) for r in sorted(got, key=lambda r: r["start"])] == [(None, 0), (1, 2), (2, 3), (2, 5)]
    path = fresh_path(spark, "store")
    token_store.write_store(no_documents, path, words, 1)
    assert token_store.read_store(spark, path).count() == 0


def test_counts(odd_documents, no_documents, odd_texts):
    path = public_tokenizers.path(FILES[0])
    got = token_counts.token_counts(odd_documents.withColumn("n_tokens", odd_documents.n_chars), path).collect()
    rows = odd_documents.collect()
    ids = ids_of(FILES[0], [r["text"] for r in rows])
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(x)) for r, x in zip(rows, ids)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_counts.token_counts(no_documents, path).count() == 0


def checked(pieces_, full, size):
    """Each id lies once in a piece; sequences have no gap and are full but for powers of two."""
    docs, sequences = {}, {}
    for r in pieces_:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        docs.setdefault(r["doc_id"], []).append((r["start"], ids.tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in docs.items()} == full
    for parts in sequences.values():
        ends = 0
        for offset, n in sorted(parts):
            assert offset == ends
            ends += n
        assert ends == size or (ends < size and ends & (ends - 1) == 0)
    return sequences


@pytest.mark.parametrize("size", [1024, 16])
def test_packing(odd_documents, size):
    path = public_tokenizers.path(FILES[0])
    rows = odd_documents.collect()
    full = {r["doc_id"]: ids + [0] for r, ids in zip(rows, ids_of(FILES[0], [r["text"] for r in rows]))}
    got = packing.pack(odd_documents.withColumn("offset", odd_documents.lang), path, 0, size).collect()
    checked(got, full, size)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(full[r["doc_id"]][r["start"] :][: r["length"]], "<u4"))
        assert r["doc_tokens"] == len(full[r["doc_id"]])


def test_packing_nothing(no_documents):
    assert packing.pack(no_documents, public_tokenizers.path(FILES[0]), 0).count() == 0


def test_each_piece_goes_to_the_best_level():
    """Against the definition: try every open level, add up the squares."""
    rnd = np.random.default_rng(3)
    packer = packing.Packer(32)
    for n in rnd.integers(1, 32, 400).tolist():
        level = packer.best_level(n)

        def after(h):
            levels = packer.levels.copy()
            levels[h] -= h > 0
            levels[h + n] += h + n < 32
            return int((levels[1:32] ** 2).sum())

        open_levels = [h for h in range(33 - n) if h == 0 or packer.levels[h]]
        assert after(level) == min(map(after, open_levels))
        packer.add(1, np.zeros(n, np.uint32))
    open_windows = int(packer.levels.sum())
    assert open_windows < 2 * 32
    packer.close()
    assert sum(1 for w in packer.done if sum(len(p[2]) for p in w) < 32) <= 5
