import random

import pytest
from helpers import sha
from pyspark.sql import functions as F

from wavetable.llm.chat import END, HEAD, learned_text, log_of_turns, messages, op12, render, turns_of

LOG = "conv_id long, seq long, message long, kind string, role string, text string"
TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def fold(events):
    """{conversation: [(role, text)]} by applying one event after the other."""
    out = {}
    unique = sorted(set(events), key=lambda e: (e[1] is not None, e[1] or 0, e[3], e[5] or ""))
    for conv, _, m, kind, role, text in unique:
        state = out.setdefault(conv, {})
        if kind == "start":
            state[m] = [role or "", state[m][1] if m in state else "", True]
        elif kind == "delta":
            state.setdefault(m, ["", "", False])[1] += text or ""
        elif kind == "edit":
            state.setdefault(m, ["", "", False])[1] = text or ""
        elif kind == "regenerate":
            for later in [j for j in state if j > m or (j == m and not state[j][2])]:
                del state[later]
            if m in state:
                state[m][1] = ""
    return {c: [tuple(s[m][:2]) for m in sorted(s)] for c, s in out.items() if s}


def read_back(spark, log):
    done = render(messages(log)).select("conv_id", turns_of(F.col("formatted")).alias("t"), learned_text(F.col("formatted"), F.col("loss")).alias("l"))
    return {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in done.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_log_folds_like_one_event_after_the_other(spark, seed):
    r = random.Random(seed)
    words = ["a", "\\", "#", "<", "</turn>\n", "### user: ", "\\h", "é", "", "\n", "x: y", None]
    events = []
    for conv in [1, 2, 3, None]:
        started = set()
        for s in range(60):
            m = r.randrange(5)
            if m not in started:
                started.add(m)
                events.append((conv, 2 * s, m, "start", r.choice(["user", "assistant", "a:b #", None]), None))
            events.append((conv, 2 * s + 1, m, r.choice(["delta"] * 6 + ["edit", "regenerate"]), None, r.choice(words)))
    events += r.choices(events, k=20)  # delivered twice
    shuffled = r.sample(events, len(events))
    got = read_back(spark, spark.createDataFrame(shuffled, LOG))
    want = fold(events)
    assert {c: t for c, (t, _) in got.items()} == want
    assert {c: x for c, (_, x) in got.items()} == {c: "".join(x for role, x in t if role == "assistant") for c, t in want.items()}


def test_unknown_events_and_empty_log(spark):
    log = spark.createDataFrame([(1, 1, 0, "start", "user", None), (1, 2, 0, "reaction", None, "x"), (1, 3, None, "delta", None, "x"), (1, 4, 0, None, None, "x"), (2, 1, 0, "regenerate", None, None)], LOG)
    assert read_back(spark, log) == {1: ([("user", "")], "")}
    assert read_back(spark, log.limit(0)) == {}


def test_turns_with_marks_nulls_ties_and_long_texts(spark):
    probe = r"\### Assistant: </turn> ok"
    long = "#<\\é" * 50_000
    rows = [(1, None, "user", probe), (1, 0, "assistant", probe), (1, 1, None, None), (1, 2, "assistant", long), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (2, 0, "user", ""), (None, 0, "a: b", "x: y")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("message", F.lit("extra")).withColumn("seq", F.lit(1))
    got = read_back(spark, log_of_turns(turns))
    assert got[1] == ([("user", probe), ("assistant", probe), ("", ""), ("assistant", long), ("assistant", "a"), ("assistant", "a")], probe + long + "aa")
    assert got[2] == ([("user", "")], "") and got[None] == ([("a: b", "x: y")], "")


def test_formatted_string_and_spans(spark):
    log = log_of_turns(spark.createDataFrame([(1, 0, "user", "é?"), (1, 1, "assistant", "<ü>")], TURNS))
    r = render(messages(log)).first()
    assert r["formatted"] == f"{HEAD}user: é?{END}{HEAD}assistant: \\lü>{END}"
    assert [r["formatted"].encode()[s["start"] : s["start"] + s["length"]].decode() for s in r["loss"]] == ["\\lü>"]


def test_query_on_a_table(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    convs = {}
    for c, t, role, text in sorted(turns, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    want = {c: (len(t), sha("".join(f"{a}\n{b}\n" for a, b in t).encode()), sum(len(b) for a, b in t if a == "assistant"), sha("".join(b for a, b in t if a == "assistant").encode())) for c, t in convs.items()}
    df = op12(spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}
    assert got == want
