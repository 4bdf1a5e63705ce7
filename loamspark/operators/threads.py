"""Thread decisions (X61): a memory of each conversation that sidetracks, resumes, resets and changes topic.

One step of the machine sets, keeps, saves or restores values. A value is written as a tuple of what it is the first
non-null of: names of values at the start of a span, and a constant. So the same step runs on a known state and on an
unknown one, and a long thread is cut into spans: each span is first reduced to what it does to any state, the few spans
of a thread are then followed in order, and last each span is replayed from the state it begins with. No task holds a
whole thread.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decisions, wordings that say nothing, and how much of each list is kept.
DECISIONS = ("continue", "sidetrack", "resume", "reset", "topic_change")
LOW_SIGNAL = re.compile(r"(ok|okay|cool|yes|yep|sure|thanks|thank you|got it|nice|lol|maybe|hmm|wait|hold on)[.!?]*")
LISTS = {"constraints": 12, "details": 20, "questions": 12, "clarifications": 12}
CORE = ("goal", "subject", "service")
START = "Thread started."
SPACE = re.compile("[\t\n\x0b\f\r \xa0  -     　﻿]+")

FIELDS = (*CORE, *LISTS, "summary", "status", "sidetrack", *(f"paused_{x}" for x in (*CORE, "constraints", "summary")))
Value = tuple
State = dict[str, Value]


def clean(text: str | None) -> str:
    return SPACE.sub(" ", (text or "").replace("\x00", "")).strip(" ")


def low_signal(text: str) -> bool:
    return len(text) < 4 or bool(LOW_SIGNAL.fullmatch(text.lower()))


def listed(values: list | None, most: int) -> tuple[str, ...]:
    seen: dict[str, str] = {}
    for v in map(clean, values or []):
        if v and len(seen) < most:
            seen.setdefault(v.lower(), v)
    return tuple(seen.values())


def known(value: object) -> Value:
    """A constant, which is wrapped so that no list or text is taken for a name; null is none."""
    return () if value is None else (("is", value),)


def first_of(*values: Value) -> Value:
    """The first non-null of several values: nothing after a constant counts, nor a name met before."""
    out: list = []
    for part in (p for v in values for p in v):
        if part not in out:
            out.append(part)
        if isinstance(part, tuple):
            break
    return tuple(out)


def initial() -> State:
    state = dict.fromkeys(FIELDS, ())
    return state | {k: known(()) for k in LISTS} | {"summary": known(START), "status": known("active"), "sidetrack": known(False)}


def unknown() -> State:
    return {f: (f,) for f in FIELDS}


def bound(value: Value, state: State) -> Value:
    """A value in which names stand for values of ``state``."""
    return first_of(*(state[p] if isinstance(p, str) else (p,) for p in value))


class Turn(NamedTuple):
    """A decision and what is proposed: null keeps, an empty text clears."""

    decision: str
    goal: str | None
    subject: str | None
    service: str | None
    summary: str | None
    constraints: list | None
    details: list | None
    questions: list | None
    clarifications: list | None


def step(state: State, turn: Turn) -> tuple[State, list[str]]:
    """The next state, and what the guards refused; the refusals of a sidetrack are only right for a known state."""
    failures, new, sidetrack = [], dict(state), turn.decision == "sidetrack"
    said = {f: None if getattr(turn, f) is None else clean(getattr(turn, f)) for f in (*CORE, "summary")}
    if sidetrack:
        for f in CORE:
            if known(said[f] or None) != state[f]:
                said[f] = None
                failures.append(f"sidetrack_{'primary_goal' if f == 'goal' else f}_overwrite_blocked")
    if said["summary"] is not None and low_signal(said["summary"]):
        said["summary"] = None
        failures.append("low_signal_summary_blocked")
    for f in ("goal", "subject"):
        if said[f] and low_signal(said[f]):
            said[f] = None
            failures.append(f"low_signal_{f}_blocked")
    new |= {f: known(v or None) for f, v in said.items() if v is not None}
    new |= {f: known(listed(getattr(turn, f), most)) for f, most in LISTS.items() if getattr(turn, f) is not None}
    new["status"] = known("active")
    if sidetrack:
        new |= {f: state[f] for f in (*CORE, "constraints")} | {f"paused_{f}": state[f] for f in (*CORE, "constraints", "summary")}
        new |= {"status": known("paused"), "sidetrack": known(True)}
    elif turn.decision == "resume":
        new |= {f: first_of(state[f"paused_{f}"], state[f], new[f]) for f in CORE}
        new |= {"constraints": first_of(state["paused_constraints"], state["constraints"]), "sidetrack": known(False)}
    elif turn.decision == "reset":
        new = initial()
    elif turn.decision == "topic_change":
        new |= {f: known(()) for f in ("constraints", "questions", "clarifications")} | {"sidetrack": known(False)}
        new |= {f"paused_{f}": () for f in (*CORE, "constraints", "summary")}
    return new, failures


def plain(state: State) -> dict:
    return {f: (v[0][1] if v else None) for f, v in state.items()}


def _written(state: State) -> str:
    return json.dumps({f: [p if isinstance(p, str) else {"is": p[1]} for p in v] for f, v in state.items()})


def _read(text: str) -> State:
    own = lambda p: p if isinstance(p, str) else ("is", tuple(p["is"]) if isinstance(p["is"], list) else p["is"])
    return {f: tuple(map(own, v)) for f, v in json.loads(text).items()}


TURN = "decision", "goal", "subject", "service", "summary", "constraints", "details", "questions", "clarifications"
OUT = "turn long, decision string, status string, goal string, subject string, service string, constraints array<string>, details array<string>, questions array<string>, clarifications array<string>, summary string, sidetrack boolean, paused_goal string, failures string, changed boolean"
SHOWN = ("status", *CORE, *LISTS, "summary", "sidetrack", "paused_goal")


def turns_of(rows: pd.DataFrame) -> Iterator[tuple[int, Turn]]:
    for at, *values in rows[["turn", *TURN]].itertuples(index=False):
        yield at, Turn(*(None if v is None or v is pd.NA or isinstance(v, float) else list(v) if not isinstance(v, str) else v for v in values))


def replayed(state: State, rows: pd.DataFrame) -> tuple[State, list[tuple]]:
    """The state after some turns in order, and a row for each."""
    out = []
    for at, turn in turns_of(rows):
        new, failures = step(state, turn)
        now = plain(new)
        out.append((at, turn.decision, *(list(now[f]) if f in LISTS else now[f] for f in SHOWN), ",".join(failures), new != state))
        state = new
    return state, out


COLUMNS = ["turn", "decision", *SHOWN, "failures", "changed"]


def thread_memory(turns: DataFrame, span: int = 1000) -> DataFrame:
    """The memory of each thread after each of its turns (thread, turn, decision and proposals), turns in order of ``turn``.

    ``span`` numbers of turns make a span, whatever turns there are in it.
    """
    own = turns.select("thread", "turn", *TURN).withColumn("span", F.floor(F.col("turn") / span))
    kind = dict(own.dtypes)["thread"]

    def reduced(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = unknown()
        for _, turn in turns_of(rows.sort_values("turn", kind="stable")):
            state = step(state, turn)[0]
        return pd.DataFrame({"thread": [key[0]], "span": [key[1]], "effect": [_written(state)]})

    def followed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = initial(), []
        for span, effect in rows.sort_values("span")[["span", "effect"]].itertuples(index=False):
            out.append((key[0], span, _written(state)))
            state = {f: bound(v, state) for f, v in _read(effect).items()}
        return pd.DataFrame(out, columns=["thread", "span", "state"])

    def shown(key: tuple, rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["thread", *COLUMNS])
        state = _read(start["state"].iloc[0])
        return pd.DataFrame([(key[0], *r) for r in replayed(state, rows.sort_values("turn", kind="stable"))[1]], columns=["thread", *COLUMNS])

    effects = own.groupBy("thread", "span").applyInPandas(reduced, f"thread {kind}, span long, effect string")
    starts = effects.groupBy("thread").applyInPandas(followed, f"thread {kind}, span long, state string")
    return own.groupBy("thread", "span").cogroup(starts.groupBy("thread", "span")).applyInPandas(shown, f"thread {kind}, {OUT}")

