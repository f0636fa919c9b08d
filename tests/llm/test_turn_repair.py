import hashlib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from labelkite.llm import turn_repair
from labelkite.llm.turn_repair import Search

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def brute_force(rows):
    """Cheapest edits, ties to the least text, by trying all; rows are (initial, bad, truncated)."""
    best = None
    for inserts in product(range(3), repeat=len(rows) + 1):
        for edits in product("KRD", repeat=len(rows)):
            cost, roles, audit = 3 * sum(inserts), [], "I" * inserts[0]
            roles += ["*"] * inserts[0]
            for (initial, bad, truncated), e, n in zip(rows, edits, inserts[1:]):
                if bad and e != "D":
                    break
                cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if truncated and e != "D" else 0)
                roles += {"K": [initial], "R": ["*"], "D": []}[e] + ["*"] * n
                audit += e + "I" * n
            else:
                if legal(roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def legal(roles):
    """``(s?(ua)+)?``, a star being u or a."""
    if roles and roles[0] == "s":
        roles = roles[1:]
        if not roles:
            return False
    return len(roles) % 2 == 0 and all(r in ("*", "ua"[i % 2]) for i, r in enumerate(roles))


def searched(rows):
    search = Search()
    audit = "".join([search.row(*r) for r in rows])
    return audit + search.end(), search


def test_search_against_all_edits():
    rnd = random.Random(3)
    kinds = [(i, False, t) for i in "suax" for t in (False, True)] + [("u", True, False)]
    for n in range(5):
        for _ in range(60 if n < 4 else 25):
            rows = [rnd.choice(kinds) for _ in range(n)]
            audit, search = searched(rows)
            assert audit == brute_force(rows)[1], rows


def test_edits_go_out_early_and_nodes_are_freed():
    search, out = Search(), ""
    for i in range(20_000):
        out += search.row("ua"[i % 2], False, i % 7 == 0)
        assert len(search.tree) < 40 and len(out) > i - 10
    assert len(out + search.end()) >= 20_000


def test_ties_that_stay_open_to_the_end():
    """Only users: two survivors differ from the first edits on, and the least text wins."""
    for n in (2, 3, 4, 5):
        assert searched([("u", False, False)] * n)[0] == (brute_force([("u", False, False)] * n)[1])
    audit, search = searched([("u", False, False)] * 3001)
    assert audit == "KI" + "KR" * 1500 and len(search.tree) <= 2 * 3001 + 8


def plain(rows):
    """The contract's result of conversations, straight from the rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, judged = set(), [], []
        for _, _, role, text in own:
            core = text.rstrip(WHITE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            judged.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = brute_force(judged)
        left, k = [], 0
        for e in audit:
            role, text = ("", "") if e == "I" else own[k][2:]
            k += e != "I"
            if e != "D":
                asked = sum(1 for r, _ in left if not r.startswith("s")) % 2 == 0
                left.append((role if e == "K" else "user" if asked else "assistant", "" if e == "I" else text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0] + b[0] for a, b in zip(judged, judged[1:])]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def got(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def some_rows():
    rnd = random.Random(5)
    texts = ["Yes.", "No!\n", "half a", "", " \t\n", "tail .x", "ends?\x0b \x0c", "日本", "long " * 50_000]
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rnd.randint(1, 4)):
            rows.append((conv, rnd.choice([None, 0, 1, 1, 2, 5]), rnd.choice(["user", "assistant", "system", "tool", "us"]), rnd.choice(texts)))
    return rows


def test_repair_against_brute_force(spark):
    rows = some_rows()
    want = plain(rows)
    frame = spark.createDataFrame(rows, ROWS).withColumn("cost", F.lit("x")).withColumn("edit", F.lit(1)).repartition(5)
    repaired = turn_repair.repair(frame)
    assert got(turn_repair.summary(repaired)) == want
    assert got(turn_repair.summary(repaired.repartition(3), arranged=False)) == want
    kept = repaired.where("edit in ('K', 'R')").count()
    assert kept == sum(a.count("K") + a.count("R") for *_, a, _ in want.values())


def test_nulls_repeats_rows_that_only_name_and_nothing(spark):
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = [(1, 0, "user", "Hi.", True), (1, 1, None, None, True), (1, 2, "assistant", "Yo.", True),
            (2, 0, "user", "Hi.", False), (2, 1, "user", "Hi.", None), (3, 0, "user", "a.", False), (3, 1, "assistant", "b.", True)]
    frame = spark.createDataFrame(rows, ROWS + ", there boolean")
    out = got(turn_repair.summary(turn_repair.repair(frame, present=F.col("there"))))
    assert out[1][1] == 1 and out[1][6] == "KDK" and out[1][4] == 2
    assert out[2] == nothing
    assert out[3][6] == "IK"
    assert turn_repair.summary(turn_repair.repair(frame.drop("there").limit(0))).count() == 0


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_damage(spark, kind):
    rows = spark.range(300).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("system").alias("role"), F.lit("A. b?").alias("text")
    )
    key = F.crc32(F.concat(F.lit("7:"), F.col("turn").cast("string"))) % 20
    turns = [r[0] for r in rows.where(key == kind).select("turn").collect()]
    out = turn_repair.damaged(rows).where(F.col("turn").isin(turns)).drop("conv_id", "turn").collect()
    want = {0: ("system", "A. b?", False), 1: ("system", "", True), 2: ("system", "A b", True),
            3: ("system", "A. b?", True), 4: ("user", "A. b?", True)}[kind]
    assert [tuple(r) for r in out] == [want] * len(turns) * (2 if kind == 3 else 1) and turns
