import random

import pandas as pd
import pytest

from loamspark.operators import threads as O
from loamspark.streaming import events as S

KIND = "thread long, turn long, decision string, goal string, subject string, service string, summary string, constraints array<string>, details array<string>, questions array<string>, clarifications array<string>"


def turns(seed, threads=6, most=40):
    rng, rows = random.Random(seed), []
    text = lambda: rng.choice([None, None, "", "ok", "Plan a  trip", "plan B now", "thanks!", "a\x00 long goal"])
    many = lambda: rng.choice([None, None, [], ["x", "X ", "y"], [str(i) for i in range(30)]])
    for thread in range(threads):
        for turn in sorted(rng.sample(range(100), rng.randint(1, most))):
            rows.append((thread, turn, rng.choice(O.DECISIONS), *(text() for _ in range(4)), *(many() for _ in range(4))))
    return rows


def plain(rows):
    out = {}
    for thread in {r[0] for r in rows}:
        state = O.initial()
        for r in sorted(x for x in rows if x[0] == thread):
            state, failures = O.step(state, O.Turn(*r[2:]))
            now = O.plain(state)
            out[thread, r[1]] = (now["status"], now["goal"], now["subject"], now["service"], list(now["constraints"]), list(now["details"]), now["summary"], now["sidetrack"], now["paused_goal"], ",".join(failures))
    return out


def found(df):
    return {(r["thread"], r["turn"]): (r["status"], r["goal"], r["subject"], r["service"], r["constraints"], r["details"], r["summary"], r["sidetrack"], r["paused_goal"], r["failures"]) for r in df.collect()}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_spans_equal_one_pass(spark, span):
    rows = turns(span)
    assert found(O.thread_memory(spark.createDataFrame(rows, KIND).repartition(4), span)) == plain(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = turns(5)
    df = spark.createDataFrame(rows, KIND)
    for k, (a, z) in enumerate([(0, 30), (30, 31), (31, 100)]):
        df.where(f"turn >= {a} and turn < {z}").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    for k in range(3):  # files in order of time
        for f in (tmp_path / str(k)).glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
            (tmp_path / "in" / f"{k}.parquet").touch()
    stream = S.thread_memory(S.read(spark, f"{tmp_path}/in", KIND, files=1))
    q = stream.writeStream.format("memory").queryName("threads").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert found(spark.table("threads")) == found(O.thread_memory(df, 10)) == plain(rows)


def test_resume_restores_what_a_sidetrack_saved():
    say = lambda decision, goal=None: O.Turn(decision, goal, None, None, None, None, None, None, None)
    state = O.initial()
    for turn in (say("continue", "first goal"), say("sidetrack", "other goal"), say("continue", "third goal"), say("resume", "fourth goal")):
        state, failures = O.step(state, turn)
    assert O.plain(state)["goal"] == "first goal" and O.plain(state)["status"] == "active" and failures == []
    state, _ = O.step(state, say("topic_change"))
    state, _ = O.step(state, say("resume", "last goal"))
    assert O.plain(state)["goal"] == "first goal"  # nothing is paused: the present goal stays
    assert O.step(O.initial(), say("continue", "hm"))[1] == ["low_signal_goal_blocked"]


def test_nothing(spark):
    assert O.thread_memory(spark.createDataFrame([], KIND)).collect() == []
    assert isinstance(pd.DataFrame(columns=O.COLUMNS), pd.DataFrame)
