import base64
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelkite.llm import secrets as S

rnd = random.Random(3)


def in_either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


WORDS = "|".join(in_either_case(w) for w in ["password", "passwd", "secret", "token", "api_?key"])
ASSIGN = re.compile(rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def odd_text():
    parts = ["password", "PassWD", "secret", "toKen", "api_key", "ApiKey", ":", "=", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef",
             "0123456789abcdef", "x", "-", "é", "ſecret=abcdefgh", "toKen:abcdefg", "\n", "a.b"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))


def test_known_spans():
    for _ in range(4000):
        t = odd_text()
        assert S.known_spans(t) == brute(t)


def secret(n):
    return base64.b64encode(rnd.randbytes(3 * n // 4)).decode().rstrip("=")


PROSE = ["theresation", "of", "inthan", "word", "underline", "readability", "a", "mother", "national", "stretches"]


def prose(n):
    return " ".join(rnd.choice(PROSE) for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rows = [(i, prose(120)) for i in range(400)]
    secrets = {i: secret(40) for i in range(0, 400, 8)}
    secrets = {i: s for i, s in secrets.items() if any(c.isdigit() for c in s)}
    rows = [(i, f"{t} {secrets[i]} {prose(30)}" if i in secrets else t) for i, t in rows]
    plain = {401: "x" * 40 + "1", 402: "1" * 50, 403: "version-1-of-the-national-mother-tongue-readability"}
    return [*rows, *plain.items(), (500, None), (501, ""), (None, "token=abcdef")], secrets, plain


def test_the_battery_finds_random_strings(spark, planted):
    rows, secrets, plain = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.spans(docs, S.thresholds(docs)).collect()}
    texts = dict(rows)
    added = {i: [texts[i][a:b] for a, kind, b in s if kind == 3] for i, s in got.items()}
    found = [i for i, s in secrets.items() if s in added[i]]
    assert len(found) >= 0.9 * len(secrets)
    assert not any(added[i] for i in added if i not in secrets)
    for i, s in got.items():
        assert [x for x in s if x[1] < 3] == brute(texts[i] or "")
    assert got[None] == [(0, 0, 12)] and got[500] == got[501] == []


def test_the_value_after_a_name_is_found(spark):
    names = ["AWS_SECRET_ACCESS_KEY", "sig", "PRIVATE_KEY"]
    rows, secrets = [(i, prose(120)) for i in range(400)], {}
    for i in range(0, 400, 8):
        secrets[i] = "7" + secret(40)[1:] + ("==" if i % 16 else "")
        rows[i] = (i, f"{rows[i][1]} {names[i % 3]}={secrets[i]} {prose(30)}")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = dict(rows)
    got = S.spans(docs, S.thresholds(docs)).collect()
    added = {r["doc_id"]: [texts[r["doc_id"]][a:b] for a, kind, b in r["spans"] if kind == 3] for r in got}
    assert sum(added[i] == [s] for i, s in secrets.items()) >= 0.9 * len(secrets)
    assert not any(added[i] for i in added if i not in secrets)
    padded = "MFRGG43UNRUW4ZZAORSXQ5BAMZXXE===="
    assert [c[:2] for c in S.candidates(f"a {padded} b")] == [(2, 2 + len(padded))]


def test_ordinary_text_is_the_whole_text(spark):
    while True:  # a header that looks random where a string of 40 letters begins
        words = [re.sub("[^A-Za-z]", "", secret(48))[:8] for _ in range(20)]
        if S.score_class("".join(words)[:40]) <= 2:
            break
    header = " ".join(words)
    rows = [(i, f"{header if i % 3 == 0 else ''} {prose(1500)}") for i in range(300)]
    secrets = {i: "7" + secret(40)[1:] for i in range(0, 300, 5)}
    rows = [(i, f"{t} {secrets[i]} end" if i in secrets else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = dict(rows)
    got = S.spans(docs, S.thresholds(docs)).collect()
    added = {r["doc_id"]: [texts[r["doc_id"]][a:b] for a, kind, b in r["spans"] if kind == 3] for r in got}
    assert sum(added[i] == [s] for i, s in secrets.items()) >= 0.9 * len(secrets)
    assert not any(added[i] for i in added if i not in secrets)


def test_every_letter_is_counted_once_for_each_length():
    texts = [f"é {prose(700)} 12 {prose(3)}", "", "ab", f"{prose(40)} {secret(40)}1 {prose(40)}"]
    letters = [re.sub("[^A-Za-z]", "", t) for t in texts[:3]]
    letters.append(re.sub("[^A-Za-z]", "", " ".join(w for w in texts[3].split() if not any(map(str.isdigit, w)))))
    assert [S.ordinary_letters(t).decode() for t in texts] == letters
    counts = S.ordinary_counts([S.ordinary_letters(t) for t in texts])
    want = np.zeros_like(counts)
    for t in letters:
        for k, n in enumerate(S.LENGTHS.tolist()):
            for i in range(0, len(t) - n + 1, n):
                want[k, S.score_class(t[i : i + n])] += 1
    assert (counts == want).all() and want[0].sum() > 200


def test_long_runs_are_tested_to_their_end(spark):
    def joined(n):
        return "_".join(rnd.choice(PROSE) for _ in range(n))[: 6 * n]

    def blob(n):
        return "".join(secret(400) for _ in range(n // 400 + 1))[:n]

    rows, secrets = [(i, prose(300)) for i in range(400)], {}
    for i in range(0, 400, 8):
        before, after, size = [(joined(70), "", 40), ("", joined(120), 300), ("", "", 1000), (joined(60), joined(60), 64)][i // 8 % 4]
        secrets[i] = len(rows[i][1]) + 1 + len(before), size
        padding = "" if after else "=="
        rows[i] = (i, f"{rows[i][1]} {before}{blob(size)}{after}{padding} {prose(30)}")
    rows[1] = (1, f"{rows[1][1]} {joined(200)}_2_{joined(200)} {prose(3)}")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(a, b) for a, kind, b in r["spans"] if kind == 3] for r in S.spans(docs, S.thresholds(docs)).collect()}
    for i, (start, size) in secrets.items():
        inside = sum(max(0, min(b, start + size) - max(a, start)) for a, b in got[i])
        assert inside >= 0.75 * size
        assert sum(b - a for a, b in got[i]) - inside <= 192  # a passing stretch may reach over either border
        if size == 1000:
            assert got[i] == [(start, start + size + 2)]
    assert not any(got[i] for i in got if i not in secrets)


def test_what_follows_256_characters_counts():
    assert S.symbols("0f" * 150 + "z")[1] == 36
    assert S.symbols("0f" * 150 + "~") is None
    last = [b for _, b, _, _ in S.candidates("x" * 300 + "12345678901234567890")]
    assert max(last) == 320


def test_nothing(spark, no_documents):
    assert S.spans(no_documents, S.thresholds(no_documents)).count() == 0
    docs = spark.createDataFrame([(1, "plain words")], "doc_id long, text string")
    assert S.spans(docs, S.thresholds(docs)).first()["spans"] == []


def test_random_draws_pass_and_patterns_do_not():
    draws = [S.departure(np.array([rnd.randrange(16) for _ in range(64)]), 16) for _ in range(300)]
    assert np.mean(np.array(draws) < 3) > 0.95
    assert S.departure(np.arange(64) % 16, 16) > 4  # even, but in order
    assert S.departure(np.array([3] * 64), 16) > 4
    assert S.departure(np.array([0, 15] * 32), 16) > 4  # too many runs


def test_encodings():
    assert S.symbols("00ffAA") is None or S.symbols("00ffAA")[1] == 64
    assert [S.symbols(s)[1] for s in ("00ff", "MFRGG", "zz09", "aZ9+", "a-_9Z")] == [16, 32, 36, 64, 64]
    assert S.symbols("é" * 30) is None


def test_false_discovery_rule():
    found, null = np.zeros((2, 4)), np.zeros((2, 4))
    null[:, 3] = 1000
    found[0, 0] = 5
    found[1, 3] = 5
    cut = S.benjamini_hochberg(found, null, 0.01)
    assert cut == [2, 2]
    assert S.benjamini_hochberg(np.zeros((2, 4)), null, 0.01) == [-1, -1]
    null[0, 0] = 900  # ordinary strings of this length look random as well
    assert S.benjamini_hochberg(found, null, 0.01)[0] == -1
