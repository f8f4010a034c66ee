"""Parsing, validity and state of tool-call trajectories (G family).

Call tables have one row per call: ``traj_id, step, pos, name`` and
parameters. Per-trajectory facts are aggregates, not collected lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.functions.ranking import has_hot_group, neighbour, running
from cartlight.functions.text import occurrences
from cartlight.session import materialize

# fixed values: message roles and tools
USER_ROLES = ["user"]
ASSISTANT_ROLES = ["think", "tool_call", "obs", "response"]
OUTPUT_ROLES = ["think", "tool_call", "response"]
LEGAL_TOOLS = [
    "find_product",
    "view_product_information",
    "recommend_product",
    "budget_check",
    "python_execute",
    "terminate",
]
BUDGET_TOOLS = ["budget_check", "python_execute"]
CALLS_TYPE = "array<struct<name:string,parameters:map<string,string>>>"


@F.pandas_udf(T.StringType())
def salvage_json(texts: pd.Series) -> pd.Series:
    """First JSON list or object inside a broken text, as a JSON list."""
    decoder = json.JSONDecoder()

    def first_value(text):
        if text is None:
            return None
        for at in (i for i, ch in enumerate(text) if ch in "[{"):
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                continue
            return json.dumps(value if isinstance(value, list) else [value])
        return None

    return texts.map(first_value)


def inner_text(content: Column, role: str) -> Column:
    """Trimmed text of the first ``<role>`` block, null when absent or empty."""
    text = F.regexp_extract(content, f"(?s)<{role}>(.+?)</{role}>", 1)
    return F.nullif(F.trim(text, F.lit(" \n\t\r")), F.lit(""))


def parse_message(df: DataFrame, *, content: str = "content", reasoning: str | None = None, salvage: bool = True) -> DataFrame:
    """Tagged text to ``think, calls, response, format_error``.

    Exactly one call block is allowed. Text that is not valid JSON goes
    through the salvage function; valid rows pass null to it.
    """
    c = F.col(content)
    n_open, n_close = occurrences(c, "<tool_call>"), occurrences(c, "</tool_call>")
    broken = (n_open != n_close) | (n_open > 1)
    raw = F.when(~broken, inner_text(c, "tool_call"))
    listed = F.when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]"))).otherwise(raw)
    think = inner_text(c, "think")
    if reasoning:
        own = F.trim(F.replace(F.replace(F.col(reasoning), F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit("")))
        think = F.coalesce(think, F.nullif(own, F.lit("")))
    out = df.withColumns(
        {
            "format_error": F.when(broken, "exactly_one_tool_call_block_required"),
            "think": think,
            "_listed": listed,
            "_valid": F.try_parse_json(listed).isNotNull(),
        }
    )
    if salvage:
        out = out.withColumn("_fixed", salvage_json(F.when(~F.col("_valid"), F.col("_listed"))))
        text = F.when(F.col("_valid"), F.col("_listed")).otherwise(F.col("_fixed"))
    else:
        text = F.when(F.col("_valid"), F.col("_listed"))
    calls = F.from_json(text, CALLS_TYPE)
    named = F.coalesce(F.exists(calls, lambda x: x["name"].isNull()), F.lit(False))
    return (
        out.withColumn("calls", F.when(~named, calls))
        .withColumn("response", F.when(F.coalesce(F.size("calls"), F.lit(0)) <= 0, inner_text(c, "response")))
        .drop("_listed", "_valid", "_fixed")
    )


def sanitize(text: Column) -> Column:
    """Role tags inside a text become square brackets."""
    out = text
    for role in USER_ROLES + ASSISTANT_ROLES:
        out = F.replace(out, F.lit(f"<{role}>"), F.lit(f"[{role}]"))
        out = F.replace(out, F.lit(f"</{role}>"), F.lit(f"[/{role}]"))
    return out


def render_message(parts: dict[str, Column], *, json_roles: tuple[str, ...] = ("tool_call", "obs")) -> Column:
    """Roles back to tagged text, one block per line; empty roles are left out."""
    blocks = []
    for role in USER_ROLES + ASSISTANT_ROLES:
        if role in parts:
            body = parts[role] if role in json_roles else sanitize(parts[role])
            blocks.append(
                F.when(
                    F.coalesce(parts[role], F.lit("")) != "",
                    F.concat(F.lit(f"<{role}>"), body, F.lit(f"</{role}>")),
                )
            )
    return F.concat_ws("\n", *blocks)


def parameter_text(parameters: Column) -> Column:
    """Text of a string map as ``{'key': 'value', ...}`` in map order."""
    items = F.transform(
        F.map_entries(parameters),
        lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")),
    )
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def tool_call_id(name: Column, parameters: Column, *, length: int = 8) -> Column:
    """Short id: md5 of name and parameter text, URL-safe base64, first characters."""
    digest = F.base64(F.unhex(F.md5(F.concat(name, F.lit("\n"), parameters))))
    return F.substring(F.translate(digest, "+/=", "-_"), 1, length)


def format_valid(content: Column, *, roles: list[str] = OUTPUT_ROLES) -> Column:
    """1 when tags occur once, in order, not nested, and the call list is valid JSON."""

    def present(role: str) -> Column:
        return F.contains(content, F.lit(f"<{role}>")) | F.contains(content, F.lit(f"</{role}>"))

    def start(role: str) -> Column:
        return F.locate(f"<{role}>", content)

    def end(role: str) -> Column:
        return F.locate(f"</{role}>", content)

    ok = F.lit(True)
    if "think" in roles:
        ok = ok & present("think")
    ok = ok & (present("tool_call") | present("response"))
    for role in roles:
        once = (occurrences(content, f"<{role}>") == 1) & (occurrences(content, f"</{role}>") == 1)
        ok = ok & (~present(role) | (once & (start(role) < end(role))))
    for a in roles:
        for b in roles:
            if a != b:
                inside = ((start(a) < start(b)) & (start(b) < end(a))) | ((start(a) < end(b)) & (end(b) < end(a)))
                ok = ok & ~(present(a) & present(b) & inside)
    if "tool_call" in roles:
        body = F.regexp_extract(content, "(?s)<tool_call>(.*?)</tool_call>", 1)
        items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
        valid = F.forall(
            items,
            lambda v: F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.name", "variant")) == "STRING", F.lit(False))
            & F.coalesce(
                F.schema_of_variant(F.try_variant_get(v, "$.parameters", "variant")).startswith("OBJECT"), F.lit(False)
            ),
        )
        ok = ok & (~present("tool_call") | F.coalesce(valid, F.lit(False)))
    return F.coalesce(ok, F.lit(False)).cast("int")


def tool_valid(calls: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """Mean validity of the calls of a trajectory by per-tool rules.

    ``obs_kind`` is ``list``, ``dict``, ``text``, ``error`` or null.
    """
    name, obs = F.col("name"), F.col("obs_kind")
    has_ids = F.size(parse_product_ids(F.col("product_ids"))) > 0
    rules = (
        F.when(~name.isin(LEGAL_TOOLS) | (obs == "error"), False)
        .when(name == "find_product", F.col("q").isNotNull() & F.col("page").isNotNull() & (obs == "list"))
        .when(name == "view_product_information", has_ids & (obs == "list"))
        .when(name == "recommend_product", has_ids & obs.isNotNull())
        .when(name == "terminate", F.col("status").isin("success", "failure") & obs.isNotNull())
        .when(name == "budget_check", has_ids & (obs == "dict"))
        .otherwise(obs == "dict")
    )
    ok = F.coalesce(rules, ~name.isin(LEGAL_TOOLS) & F.lit(False)).cast("int")
    return calls.groupBy(by).agg(F.avg(ok).alias("tool_valid"), F.count("*").alias("n_calls"))


def turn_flags(calls: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """One row per turn: which kinds of tools it uses."""

    def any_of(cond: Column) -> Column:
        return F.max(cond.cast("int"))

    name = F.col("name")
    return calls.groupBy(by, "step").agg(
        any_of(name == "find_product").alias("has_find"),
        any_of(name == "view_product_information").alias("has_view"),
        any_of(name.isin(BUDGET_TOOLS)).alias("has_budget"),
        any_of(name == "recommend_product").alias("has_recommend"),
        any_of(name == "terminate").alias("has_terminate"),
        any_of(~name.isin(LEGAL_TOOLS)).alias("has_illegal"),
    )


def workflow_valid(calls: DataFrame, *, by: str = "traj_id", hot: bool | None = None) -> DataFrame:
    """SEARCH - SELECT - DECISION - DONE as running facts instead of a fold.

    A turn is fine by what came before it: a view or budget turn needs a
    search and no decision since the last search; a budget needs a view since
    then; the closing turn needs a decision after the last search; nothing may
    follow the closing turn.
    """
    turns = turn_flags(calls, by=by)
    select = (F.col("has_view") + F.col("has_budget")) > 0
    close = (F.col("has_recommend") + F.col("has_terminate")) > 0
    step = F.col("step")
    facts = running(
        turns,
        [by],
        [step],
        {
            "last_find": ("max", F.when(F.col("has_find") == 1, step)),
            "last_budget": ("max", F.when(F.col("has_budget") == 1, step)),
            "last_view": ("max", F.when(F.col("has_view") == 1, step)),
            "n_closed": ("sum", close.cast("int")),
        },
        hot=hot,
    )
    find = F.col("has_find") == 1
    searched = F.col("last_find").isNotNull()
    undecided = F.col("last_budget").isNull() | (F.col("last_budget") < F.col("last_find"))
    viewed = (F.col("has_view") == 1) | F.coalesce(F.col("last_view") > F.col("last_find"), F.lit(False))
    turn_ok = (
        F.when((F.col("has_illegal") == 1) | (F.coalesce("n_closed", F.lit(0)) > 0), False)
        .when(find & (select | close), False)
        .when(find, True)
        .when(select & close, False)
        .when(select, searched & undecided & ((F.col("has_budget") == 0) | viewed))
        .otherwise(
            (F.col("has_recommend") == 1)
            & (F.col("has_terminate") == 1)
            & F.coalesce(F.col("last_budget") > F.col("last_find"), F.lit(False))
        )
    )
    return facts.groupBy(by).agg(F.bool_and(turn_ok).cast("int").alias("workflow_valid"))


def final_recommendation(calls: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """Last recommendation and whether the trajectory ended with success."""
    rec = F.when(F.col("name") == "recommend_product", F.struct("step", "pos", F.coalesce("product_ids", F.lit("")).alias("ids")))
    done = (F.col("name") == "terminate") & (F.col("status") == "success")
    return calls.groupBy(by).agg(
        F.coalesce(F.max(rec)["ids"], F.lit("")).alias("recommended_ids"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("terminate_success"),
    )


def parse_product_ids(value: Column) -> Column:
    """Comma list, else the runs of five or more digits."""
    listed = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    digits = F.regexp_extract_all(value, F.lit(r"(\d{5,})"), 1)
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(F.contains(value, F.lit(",")), listed).otherwise(digits), none)


def pair_calls_observations(calls: DataFrame, observations: DataFrame, *, keys: list[str] = ("traj_id", "step", "tool_call_id")) -> DataFrame:
    """Calls with their observation by id; ``missing_observation`` where there is none."""
    marked = observations.withColumn("_seen", F.lit(True))
    joined = calls.join(marked, list(keys), "left")
    return joined.withColumn("missing_observation", F.col("_seen").isNull()).drop("_seen")


def product_evidence(observed: DataFrame, fields: list[str], *, by: str = "traj_id") -> DataFrame:
    """Per trajectory and product: searched, viewed, merged fields (last non-null wins).

    ``observed`` has ``step, pos, name, product_id`` and the fields.
    """
    order = F.struct("step", "pos")
    return observed.groupBy(by, "product_id").agg(
        F.max((F.col("name") == "find_product").cast("int")).alias("searched"),
        F.max((F.col("name") == "view_product_information").cast("int")).alias("viewed"),
        *[F.max(F.when(F.col(f).isNotNull(), F.struct(order.alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in fields],
    )


def trajectory_state(calls: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """Selected and recommended ids, end status, budget attempt."""

    def last(cond: Column) -> Column:
        ids = F.concat_ws(",", parse_product_ids(F.col("product_ids")))
        return F.max(F.when(cond & (ids != ""), F.struct("step", "pos", ids.alias("ids"))))["ids"]

    name = F.col("name")
    agg = calls.groupBy(by).agg(
        last(name == "recommend_product").alias("recommended"),
        last(name.isin(BUDGET_TOOLS)).alias("budgeted"),
        F.max((name.isin(BUDGET_TOOLS)).cast("int")).alias("budget_attempted"),
        F.max(((name == "terminate") & F.coalesce(F.col("status") == "success", F.lit(False))).cast("int")).alias("terminate_success"),
        F.count_if((name == "terminate") & F.col("status").isNotNull()).alias("n_terminations"),
    )
    recommended = F.coalesce("recommended", F.lit(""))
    return agg.select(
        by,
        F.coalesce("budgeted", recommended).alias("selected_ids"),
        recommended.alias("recommended_ids"),
        "budget_attempted",
        "terminate_success",
        "n_terminations",
    )


def runaway_text(text: Column, *, tail: int | None = 5000, min_length: int = 30, repeats: int = 4) -> Column:
    """At least four equal long sentences in a row; ``tail`` None looks at the whole text."""
    seen = text if tail is None else F.right(text, F.lit(tail))
    raw = F.split(seen, r"(?<=[.!?])\s+|\n+", -1)
    sentences = F.transform(raw, lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))))
    start = F.struct(
        F.lit(None).cast("string").alias("previous"), F.lit(0).alias("run"), F.lit(0).alias("longest")
    )

    def step(acc: Column, s: Column) -> Column:
        long = F.length(s) >= min_length
        run = F.when(~long, 0).when(F.coalesce(s == acc["previous"], F.lit(False)), acc["run"] + 1).otherwise(1)
        return F.struct(
            F.when(long, s).alias("previous"), run.alias("run"), F.greatest(acc["longest"], run).alias("longest")
        )

    folded = F.aggregate(sentences, start, step)
    return (F.length(text) >= 160) & (folded["longest"] >= repeats)


def failure_flags(df: DataFrame, *, text_columns: list[str], output: str, tail: int | None = 5000) -> DataFrame:
    """Server error, malformed JSON, truncation and runaway text by keywords and flags."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns]))
    out = F.lower(F.coalesce(F.col(output), F.lit("")))

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)

    server = r"internal server error|server_error|engine_error|connection error"
    return df.withColumns(
        {
            "is_server_error": flag("server_error") | text.rlike(server) | out.rlike(server),
            "is_json_decode": flag("json_failure") | text.rlike("json|decode|malformed"),
            "is_truncation": flag("truncated") | text.rlike("truncate|token_limit|max_length|length"),
            "is_runaway": F.contains(text, F.lit("runaway")) | F.coalesce(runaway_text(F.col(output), tail=tail), F.lit(False)),
        }
    )


def step_mask_reasons(calls: DataFrame, *, by: str = "traj_id", hot: bool | None = None) -> DataFrame:
    """Why a step must not be trained on; one row per step with sorted distinct reasons.

    ``calls`` has ``obs_kind, n_results, within_budget`` per call and
    ``next_issue`` per step (failure feedback that the following state shows).
    """
    name, obs = F.col("name"), F.col("obs_kind")
    selection = name.isin("view_product_information", "budget_check")
    reasons = F.array_compact(
        F.array(
            F.when(name.isNull(), "no_tool_call"),
            F.when(name.isNotNull() & obs.isNull(), F.concat(F.lit("missing_observation::"), name)),
            F.when(obs == "error", F.concat(F.lit("tool_error::"), name)),
            F.when((name == "find_product") & (F.col("n_results") == 0), "empty_find_product_result"),
            F.when((name == "budget_check") & (F.col("within_budget") == 0), "budget_check_not_within_budget"),
        )
    )
    per_step = calls.groupBy(by, "step").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))).alias("reasons"),
        F.max(selection.cast("int")).alias("selects"),
        F.max("issue").alias("issue"),
    )
    after = neighbour(per_step, [by], [F.col("step")], {"next_issue": (F.col("issue"), 1)}, hot=hot)
    led = (F.col("selects") == 1) & (F.coalesce("next_issue", F.lit(0)) == 1)
    return after.select(
        by,
        "step",
        F.when(led, F.array_sort(F.array_append("reasons", F.lit("selection_led_to_failure_feedback"))))
        .otherwise(F.col("reasons"))
        .alias("reasons"),
    )


def trajectory_quality_issue(calls: DataFrame, *, by: str = "traj_id", hot: bool | None = None) -> DataFrame:
    """First reason to drop a trajectory, null when it is clean.

    ``budget_parsed`` (0/1) and ``within_budget`` describe budget calls.
    """
    name = F.col("name")
    budget = name.isin(BUDGET_TOOLS)
    order = F.struct("step", "pos")
    facts = running(
        calls.withColumn("_o", order),
        [by],
        [F.col("step"), F.col("pos")],
        {"_last": ("max", F.when(budget, F.struct("step", "pos", "within_budget")))},
        hot=hot,
    )
    issue = (
        F.when(budget & (F.col("budget_parsed") == 0), "budget_unparseable_or_failed")
        .when((name == "recommend_product") & F.col("_last").isNull(), "recommend_without_budget_calculation")
        .when(
            (name == "recommend_product") & (F.coalesce(F.col("_last")["within_budget"], F.lit(0)) != 1),
            "recommend_after_not_within_budget",
        )
    )
    agg = facts.groupBy(by).agg(
        F.min(F.when(issue.isNotNull(), F.struct("_o", issue.alias("i"))))["i"].alias("first"),
        F.max((name == "recommend_product").cast("int")).alias("saw"),
    )
    return agg.select(
        by, F.coalesce("first", F.when(F.col("saw") == 0, "missing_recommend_product")).alias("issue")
    )


def state_invariants(used: DataFrame, observed: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """Per acting step: every used id was shown at an earlier step.

    ``used``: by, step, product_id; ``observed``: by, step, product_id.
    """
    first = observed.groupBy(by, "product_id").agg(F.min("step").alias("first_seen"))
    checked = used.join(first, [by, "product_id"], "left")
    return checked.groupBy(by, "step").agg(
        F.bool_and(F.coalesce(F.col("first_seen") < F.col("step"), F.lit(False))).alias("ids_known"),
        F.count("*").alias("n_ids"),
    )


def duplicate_call_in_turn(calls: DataFrame, *, signature: Column, by: str = "traj_id") -> DataFrame:
    """Search signatures that a turn uses more than once."""
    return (
        calls.withColumn("signature", signature)
        .groupBy(by, "step", "signature")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def search_trace(calls: DataFrame, *, by: str = "traj_id", hot: bool | None = None) -> DataFrame:
    """Each search with its phase before the turn, result count and empty flag."""
    turns = calls.groupBy(by, "step").agg(
        (
            F.max((F.col("name") == "view_product_information").cast("int"))
            * F.max(F.col("name").isin(BUDGET_TOOLS).cast("int"))
        ).alias("decides"),
        F.count_if((F.col("name") == "find_product") & (F.col("n_results") > 0)).alias("nonempty"),
    )
    # a deciding turn does not count its own searches
    counted = F.when(F.col("decides") == 0, F.col("nonempty")).otherwise(0)
    facts = running(
        turns, [by], [F.col("step")], {"decided": ("max", F.col("decides")), "found": ("sum", counted)}, hot=hot
    )
    phase = (
        F.when(F.coalesce("decided", F.lit(0)) == 1, "DECISION")
        .when(F.coalesce("found", F.lit(0)) >= 2, "CANDIDATE_SELECT")
        .otherwise("CANDIDATE_SEARCH")
    )
    searches = calls.filter("name = 'find_product'").select(by, "step", "pos", "n_results")
    return searches.join(facts.select(by, "step", phase.alias("phase")), [by, "step"]).withColumn(
        "empty", F.coalesce(F.col("n_results") == 0, F.lit(False))
    )


CHAIN_SCHEMA = "traj_id bigint, step int"


def _chain_checks(rows: DataFrame) -> DataFrame:
    """Valid checks of chains, in step order: an id must be in the last valid check or found after it.

    ``rows``: traj_id, chain, step, needs (id and the step that found it last).
    Rows come sorted and in batches; one check's ids are kept.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last, held = None, None, set()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.traj_id, row.chain) != chain:
                    chain, last, held = (row.traj_id, row.chain), None, set()
                if last is None or all(need["found"] > last or need["id"] in held for need in row.needs):
                    out.append((row.traj_id, row.step))
                    last, held = row.step, {need["id"] for need in row.needs}
            yield pd.DataFrame(out, columns=["traj_id", "step"])

    sent = rows.select("traj_id", "chain", "step", "needs").repartition("traj_id", "chain")
    return sent.sortWithinPartitions("traj_id", "chain", "step").mapInPandas(scan, CHAIN_SCHEMA)


def check_chains(turns: DataFrame, *, hot: bool | None = None) -> DataFrame:
    """Checks that meet every rule but the one on earlier checks, cut into chains that do not depend on each other.

    A search with results starts a segment, so what was viewed since is known
    without any check. What was found is known too; an earlier check matters
    only for an id that was not found again after it. So a check whose ids were
    all found after the check before it is valid whatever came before, and
    starts a chain (``anchor``). Columns: traj_id, step, budget_ids, needs,
    previous, anchor, chain.
    """
    by, step = ["traj_id"], F.col("step")
    if hot is None:
        hot = has_hot_group(turns, by)

    def ids(name: str) -> Column:
        return F.coalesce(F.array_distinct(F.array_compact(name)), F.array().cast("array<string>"))

    base = turns.select("traj_id", F.col("step").cast("int").alias("step"), ids("found").alias("found"), ids("viewed").alias("viewed"), "checked")
    finds, views = F.size("found") > 0, F.size("viewed") > 0
    facts = materialize(
        running(
            base,
            by,
            [step],
            {"segment": ("sum", finds.cast("int")), "searched": ("max", F.when(finds, step)), "seen": ("max", F.when(views, step))},
            upto="current",
            hot=hot,
        ),
        "check-facts",
    )
    n = F.size("checked")
    distinct = (n > 0) & (F.size(F.array_distinct(F.array_compact("checked"))) == n)
    now = (F.size("viewed") == n) & (F.size(F.array_intersect("viewed", "checked")) == n)
    checks = facts.filter(distinct & (F.col("segment") > 0) & (F.col("seen") > F.col("searched"))).select(
        "traj_id", "step", "segment", "checked", n.alias("n"), now.alias("now")
    )
    wanted = checks.select("traj_id", "step", "segment", F.explode("checked").alias("id"))

    # views: the first one of every id in its segment, and how many ids were viewed up to a check
    firsts = facts.filter((F.col("segment") > 0) & views).select("traj_id", "segment", "step", F.explode("viewed").alias("id"))
    firsts = firsts.groupBy("traj_id", "segment", "id").agg(F.min("step").alias("first"))
    events = firsts.groupBy("traj_id", "segment", F.col("first").alias("step")).agg(F.count("*").alias("new"))
    events = events.select("*", F.lit(0).alias("kind")).unionByName(checks.select("traj_id", "segment", "step", F.lit(0).cast("bigint").alias("new"), F.lit(1).alias("kind")))
    counted = running(events, ["traj_id", "segment"], [step, F.col("kind")], {"n_viewed": ("sum", F.col("new"))}, upto="current", hot=hot)
    counted = counted.filter("kind = 1").select("traj_id", "step", "n_viewed")

    # finds: the last one of every wanted id up to the check
    found = facts.filter(finds).select("traj_id", "step", F.explode("found").alias("id")).join(wanted.select("traj_id", "id").distinct(), ["traj_id", "id"], "left_semi")
    asked = wanted.select("traj_id", "id", "step", "segment", F.lit(None).cast("int").alias("at"), F.lit(1).alias("kind"))
    both = asked.unionByName(found.select("traj_id", "id", "step", F.lit(None).cast("bigint").alias("segment"), F.col("step").alias("at"), F.lit(0).alias("kind")))
    dated = running(both, ["traj_id", "id"], [step, F.col("kind")], {"found": ("max", F.col("at"))}, upto="current", hot=hot).filter("kind = 1")
    facts_of = dated.join(firsts, ["traj_id", "segment", "id"], "left").groupBy("traj_id", "step").agg(
        F.count_if(F.col("found").isNull()).alias("n_unknown"),
        F.min("found").alias("oldest"),
        F.count_if(F.col("first") <= F.col("step")).alias("n_in"),
        F.collect_list(F.struct("id", "found")).alias("needs"),
    )
    whole = (F.col("n_in") == F.col("n")) & (F.col("n_viewed") == F.col("n"))
    good = checks.join(facts_of, ["traj_id", "step"]).join(counted, ["traj_id", "step"]).filter((F.col("n_unknown") == 0) & (F.col("now") | whole))
    good = good.select("traj_id", "step", F.array_join("checked", ",").alias("budget_ids"), "oldest", "needs")
    after = running(good, by, [step], {"previous": ("max", step)}, hot=hot)
    anchor = F.col("previous").isNull() | (F.col("oldest") > F.col("previous"))
    return running(after.withColumn("anchor", anchor), by, [step], {"chain": ("sum", F.col("anchor").cast("int"))}, upto="current", hot=hot).drop("oldest")


def valid_checks(turns: DataFrame, *, hot: bool | None = None) -> DataFrame:
    """Budget checks backed by views after the last non-empty search: traj_id, step, budget_ids.

    ``turns``: one row per traj_id and step with found (ids), viewed (ids) and
    checked (ids of a budget check whose amounts agree, else null). A check
    counts if it names distinct ids, all active (found since the last valid
    check, or part of it), and exactly those viewed in its turn or since the
    last search, with a view in a later turn than that search.

    A trajectory of any length is spread over tasks (``hot``; counted if not
    given): views and finds are running facts, and checks fall into chains by
    themselves (``check_chains``). Only a chain of several checks is scanned in
    order, over the checks alone; a chain goes on as long as ids are checked
    again without being found again. Null ids are left out of finds and views;
    a check that names one never counts. An empty table gives an empty one.
    """
    rows = materialize(check_chains(turns, hot=hot), "check-chains")
    linked = rows.filter("not anchor").select("traj_id", "chain").distinct()
    later = _chain_checks(rows.join(linked, ["traj_id", "chain"], "left_semi"))
    later = rows.filter("not anchor").join(later, ["traj_id", "step"], "left_semi")
    return rows.filter("anchor").unionByName(later).select("traj_id", "step", "budget_ids")


def state_of_turns(turns: DataFrame, *, by: str = "traj_id", hot: bool | None = None) -> DataFrame:
    """State after every turn with its reason.

    ``turns``: nonempty (searches with results), selects (0/1: views or budget
    checks), check (0/1: a valid check ends here).
    """
    step = F.col("step")
    facts = running(
        turns,
        [by],
        [step],
        {
            "n_found": ("sum", F.col("nonempty")),
            "last_found": ("max", F.when(F.col("nonempty") > 0, step)),
            "last_select": ("max", F.when(F.col("selects") > 0, step)),
            "last_check": ("max", F.when(F.col("check") > 0, step)),
        },
        upto="current",
        hot=hot,
    )
    no_check = F.col("last_check").isNull()
    retry = F.coalesce(F.col("last_found") > F.col("last_check"), F.lit(False))
    attempted = F.coalesce(F.col("last_select") > F.col("last_found"), F.lit(False))
    reason = (
        F.when(no_check & F.col("last_found").isNull(), "nothing_found")
        .when(no_check & (F.col("n_found") < 2) & ~attempted, "first_results")
        .when(no_check, "choosing")
        .when(retry, "new_results_after_check")
        .otherwise("checked")
    )
    state = (
        F.when(F.col("reason").isin("nothing_found", "first_results"), "CANDIDATE_SEARCH")
        .when(F.col("reason").isin("choosing", "new_results_after_check"), "CANDIDATE_SELECT")
        .otherwise("DECISION")
    )
    return facts.withColumn("reason", reason).withColumn("state", state)


def local_evaluation(final: DataFrame, observed: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """Totals of the recommended ids by the prices the trajectory itself saw first."""
    first = observed.groupBy(by, "product_id").agg(
        F.min(F.struct("step", "pos", "rank_in_result", "price", "shop_id")).alias("seen")
    )
    ids = final.select(by, F.explode(parse_product_ids(F.col("recommended_ids"))).alias("product_id"))
    return (
        ids.join(first, [by, "product_id"], "left")
        .groupBy(by)
        .agg(
            F.count("*").alias("n_recommended"),
            F.count_if(F.col("seen").isNull()).alias("n_missing"),
            F.round(F.coalesce(F.sum("seen.price"), F.lit(0.0)), 2).alias("total"),
            F.min("seen.shop_id").alias("shop_min"),
            F.max("seen.shop_id").alias("shop_max"),
        )
    )
