"""Event logs folded, rendered and read back, against plain loops."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import chat

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, mark string, base int"


def folded(events):
    """What a chat program shows that follows the log."""
    shown = defaultdict(dict)
    seen = set()
    low = lambda v: (v is not None, v)
    for c, s, kind, t, role, text in sorted(events, key=lambda e: (low(e[0]), low(e[1]), low(e[2]), e[4] or "", e[5] or "")):
        if (c, t, s) in seen:
            continue
        seen.add((c, t, s))
        turns = shown[c]
        if kind == "open":
            turns[t] = (role or "", text or "")
        elif t not in turns and kind != "regenerate":
            continue
        elif kind == "delta":
            turns[t] = (turns[t][0], turns[t][1] + (text or ""))
        elif kind == "edit":
            turns[t] = (turns[t][0], text or "")
        elif kind == "regenerate":
            if t in turns:
                turns[t] = (turns[t][0], text or "")
            for later in [x for x in turns if low(x) > low(t)]:
                del turns[later]
    return sorted(repr((c, t, *m)) for c, turns in shown.items() for t, m in turns.items())


@pytest.fixture(scope="module")
def events():
    rng, out = random.Random(3), []
    for c in [*range(60), None]:
        for s in range(rng.randrange(1, 40)):
            kind = rng.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate"])
            turn = rng.choice([0, 1, 2, 3, None]) if c == 5 else rng.randrange(4)
            out.append((c, s, kind, turn, rng.choice(["user", "assistant", None]) if kind == "open" else None, None if kind == "regenerate" else rng.choice(["a", "b ", "é", None, "<s>"])))
    return out + [e for e in out if rng.random() < 0.1]  # delivered twice


def test_fold_against_a_loop(spark, events):
    frame = spark.createDataFrame([(*e, "x", 1) for e in events], EVENTS).repartition(5)
    got = chat.fold(frame).collect()
    assert sorted(repr(tuple(r)) for r in got) == folded(events)
    assert chat.fold(frame.where("false")).count() == 0


ODD = ["", None, "</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\s>[\INST][\\/INST]", "[ROLE]x[/ROLE] y", "<", "[", "</s", "s>", "[INST", "]", "\\", "😀" * 5000, "<</s>>[[INST]]", "[SYS]\n[/SYS]", "a\nb"]


def test_texts_and_roles_come_back_whatever_they_hold(spark):
    rng = random.Random(9)
    roles = ["user", "assistant", "system", "tool", "", None, "[/ROLE]", "</s>", "User"]
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "INST]", " ", "x", "[ROLE]", "/"]
    rows = [(c, t, rng.choice(roles), rng.choice(ODD)) for c in range(40) for t in range(6)]
    rows += [(c, t, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(100, 200) for t in range(4)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (7000, None, "assistant", "first"), (7000, 0, "user", "then")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    back = chat.read_back(chat.render(frame)).collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        want[c].append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == want
    assert {r["conv_id"]: r["learned"] for r in back} == {c: [x for r, x in t if r == "assistant"] for c, t in want.items()}
    for r in back:  # no control string of a text stands by itself
        assert r["formatted"].count("</s>") == len(want[r["conv_id"]]) and r["formatted"].count("<s>") == 1
        assert r["formatted"].count("[INST]") == sum(role == "user" for role, _ in want[r["conv_id"]])


def test_logs_end_with_the_messages_they_came_from(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), "ab é" * rng.choice([0, 1, 200])) for c in range(80) for t in range(rng.randrange(1, 7))]
    rows += [(1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (2, None, None, None), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    frame = spark.createDataFrame([(*r, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq int")
    messages = chat.numbered(frame)
    log = chat.logged(messages)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    assert log.count() == log.select("conv_id", "seq").distinct().count()
    show = lambda df: sorted(repr(tuple(r)) for r in df.select("conv_id", "turn", "role", "text").collect())
    assert show(chat.fold(log)) == show(messages) and len(show(messages)) == len(rows)


def test_long_texts_and_many_turns_take_linear_time(spark):
    rows = [(1, 0, "assistant", "</s> é" * 400_000), (1, 1, "user", "x")] + [(2, t, "assistant", f"turn {t} " * 20) for t in range(5_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.render(chat.fold(chat.logged(chat.numbered(frame)))))
    got = {r["conv_id"]: (r["n"], r["d"]) for r in back.select("conv_id", F.size("turns").alias("n"), F.sha2(F.array_join("learned", "").cast("binary"), 256).alias("d")).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (2, digest(rows[0][3])), 2: (5_000, digest("".join(r[3] for r in rows[2:])))}


def test_no_python_on_the_executors(spark):
    plan = chat.op12_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Scan ExistingRDD"))
