"""Workflow, parsing and check cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cartlight.operators import trajectory as G

NAMES = {"F": "find_product", "V": "view_product_information", "P": "python_execute", "B": "budget_check", "R": "recommend_product", "T": "terminate", "X": "shell"}


@pytest.mark.parametrize(
    "turns,valid",
    [
        (["FF", "VP", "RT"], 1),
        (["F", "V", "P", "FF", "VP", "RT"], 1),
        (["F", "VB", "RT"], 1),
        (["FR"], 0),
        (["F", "T"], 0),
        (["F", "VP", "R"], 0),
        (["F", "P"], 0),
        (["F", "VP", "V"], 0),
        (["F", "X"], 0),
        (["F", "VP", "RT", "F"], 0),
    ],
)
@pytest.mark.parametrize("hot", [False, True])
def test_workflow(spark, turns, valid, hot):
    rows = [(1, s, p, NAMES[c]) for s, turn in enumerate(turns) for p, c in enumerate(turn)]
    df = spark.createDataFrame(rows, "traj_id bigint, step int, pos int, name string")
    assert G.workflow_valid(df, hot=hot).first().workflow_valid == valid


def parse(spark, content, **kw):
    return G.parse_message(spark.createDataFrame([(content,)], "content string"), **kw).first()


def test_parse_message(spark):
    row = parse(spark, '<think>look</think><tool_call>[{"name": "find", "parameters": {"q": "x", "page": 2}}]</tool_call><response>r</response>')
    assert row.think == "look" and row.calls[0]["name"] == "find" and row.calls[0]["parameters"] == {"q": "x", "page": "2"}
    assert row.response is None and row.format_error is None
    assert parse(spark, '<tool_call>{"name": "end", "parameters": {}}</tool_call>').calls[0]["name"] == "end"


def test_two_call_blocks_are_an_error(spark):
    row = parse(spark, "<tool_call>[]</tool_call><tool_call>[]</tool_call><response>ok</response>")
    assert row.format_error and row.calls is None and row.response == "ok"


def test_broken_json_is_salvaged(spark):
    content = '<tool_call>sure: [{"name": "find", "parameters": {"q": "x"}}] done</tool_call>'
    assert parse(spark, content).calls[0]["name"] == "find"
    assert parse(spark, content, salvage=False).calls is None


@pytest.mark.parametrize(
    "content,ok",
    [
        ('<think>a</think><tool_call>[{"name": "n", "parameters": {}}]</tool_call>', 1),
        ("<think>a</think><response>b</response>", 1),
        ("<response>b</response>", 0),
        ("<think>a</think>", 0),
        ("<think>a</think><think>a</think><response>b</response>", 0),
        ("<think>a<response>b</response></think>", 0),
        ('<think>a</think><tool_call>{"name": "n"}</tool_call>', 0),
        ('<think>a</think><tool_call>[{"name": "n"}]</tool_call>', 0),
        ("<think>a</think><tool_call>[</tool_call>", 0),
    ],
)
def test_format(spark, content, ok):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(G.format_valid(F.col("c")).alias("v")).first().v == ok


def test_last_recommendation_wins(spark):
    rows = [(1, 0, 0, "recommend_product", "1,2", None), (1, 2, 0, "recommend_product", "3", None), (1, 2, 1, "terminate", None, "success"), (2, 0, 0, "terminate", None, "failure")]
    df = spark.createDataFrame(rows, "traj_id bigint, step int, pos int, name string, product_ids string, status string")
    got = {r.traj_id: (r.recommended_ids, r.terminate_success) for r in G.final_recommendation(df).collect()}
    assert got == {1: ("3", True), 2: ("", False)}


def test_product_ids(spark):
    df = spark.createDataFrame([("1, 2,",), ("see 12345 and 678901, no",), ("id 12345 or 99",), (None,)], "v string")
    got = [r.p for r in df.select(G.parse_product_ids(F.col("v")).alias("p")).collect()]
    assert got == [["1", "2"], ["see 12345 and 678901", "no"], ["12345"], []]


def brute_checks(turns):
    """Checks of one trajectory straight from the rules, replaying every prefix."""
    checks = []
    for i, (found, viewed, checked) in enumerate(turns):
        last_find = max((j for j in range(i + 1) if turns[j][0]), default=-1)
        views = [(j, turns[j][1]) for j in range(max(last_find, 0), i + 1) if turns[j][1]]
        if not checked or not views or max(j for j, _ in views) <= last_find:
            continue
        if checks:
            active = set(checks[-1][1]) | {p for j in range(checks[-1][0] + 1, i + 1) for p in turns[j][0]}
        else:
            active = {p for j in range(i + 1) for p in turns[j][0]}
        accumulated = {p for _, v in views for p in v}
        if len(set(checked)) == len(checked) and set(checked) <= active and set(checked) in (set(viewed), accumulated):
            checks.append((i, checked))
    return checks


def test_valid_checks_against_replay(spark, tables):
    from cartlight.plans.trajectory_queries import check_turns

    turns = check_turns(tables)
    by = {}
    for r in turns.collect():
        by.setdefault(r.traj_id, {})[r.step] = (r.found or [], r.viewed or [], r.checked or [])
    want = {(t, s, ",".join(ids)) for t, steps in by.items() for s, ids in brute_checks([steps[k] for k in sorted(steps)])}
    got = {(r.traj_id, r.step, r.budget_ids) for r in G.valid_checks(turns).collect()}
    assert got == want and got


TURNS = "traj_id bigint, step int, found array<string>, viewed array<string>, checked array<string>"


def random_turns(seed, lengths, ids="abcd"):
    """Turns with few ids, so that checks often hang on earlier ones."""
    rng = random.Random(seed)

    def some(share, least=1):
        return rng.sample(ids, rng.randint(least, 3)) if rng.random() < share else rng.choice([None, []])

    out = []
    for traj, length in enumerate(lengths):
        viewed = set()
        for step in range(length):
            found, now = some(0.25), some(0.5)
            viewed = (set() if found else viewed) | set(now or [])
            checked = rng.choice([sorted(viewed), now, some(1.0)]) if rng.random() < 0.7 else None
            out.append((traj, step, found, now, checked))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_valid_checks_of_long_chains(spark, hot):
    rows = random_turns(5, [400, *[12] * 150])
    by = {}
    for traj, _, *turn in rows:
        by.setdefault(traj, []).append([x or [] for x in turn])
    want = {(traj, step, ",".join(ids)) for traj, turns in by.items() for step, ids in brute_checks(turns)}
    turns = spark.createDataFrame(rows, TURNS)
    got = [(r.traj_id, r.step, r.budget_ids) for r in G.valid_checks(turns, hot=hot).collect()]
    assert set(got) == want and len(got) == len(want)
    chains = G.check_chains(turns, hot=hot).collect()
    assert sum(not r.anchor for r in chains) > 50 and any(not r.anchor and (r.traj_id, r.step, r.budget_ids) not in want for r in chains)


def test_valid_checks_with_nulls_and_nothing(spark):
    rows = [
        (1, 0, ["a", None], None, None), (1, 1, None, ["a", None], ["a"]), (1, 2, None, ["a"], ["a", None]), (1, 3, None, ["a"], ["a", "a"]), (1, 4, None, None, ["a"]),
        (2, 0, None, ["a"], ["a"]), (3, 0, ["a"], ["a"], ["a"]), (3, 1, None, ["b"], ["b"]),
    ]
    got = sorted((r.traj_id, r.step) for r in G.valid_checks(spark.createDataFrame(rows, TURNS)).collect())
    assert got == [(1, 1), (1, 4)]  # not: a null id, an id twice, no search, a view in the turn of the search only, an id never found
    assert G.valid_checks(spark.createDataFrame([], TURNS)).collect() == []


def test_salvage_keeps_valid_json(spark):
    texts = ['x {"a": 1} y', "[1, 2", "none", '[{"b": [1]}]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v and json.loads(r.v) for r in df.select(G.salvage_json("t").alias("v")).collect()]
    assert got == [[{"a": 1}], None, None, [{"b": [1]}]]
