"""Training-set construction from trajectories (O family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.functions.ranking import neighbour, running
from cartlight.functions.text import word_count

# fixed value: text around a state block
STATE_BLOCK = r"(?s)<state>\s*(.*?)\s*</state>"


def prefix_examples(steps: DataFrame, *, by: str, order: str, user: str, assistant: str, system: Column | None = None) -> DataFrame:
    """One example per step: all messages up to it, loss on the last assistant turn only.

    The examples repeat earlier turns by definition; trajectories are bounded
    by the step limit of the rollout loop, so a running list is small.
    """
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col(user).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col(assistant).alias("content")),
    )
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = F.flatten(F.collect_list(pair).over(upto))
    if system is not None:
        turns = F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), turns)
    n = F.count(F.lit(1)).over(upto)
    mask = F.transform(F.sequence(F.lit(1), n), lambda i: (i == n).cast("int"))
    return steps.select(by, order, turns.alias("messages"), mask.alias("assistant_loss_mask"))


def recovery_turns(steps: DataFrame, *, by: str, order: str, masked: Column, feedback: Column, hot: bool | None = None) -> DataFrame:
    """Steps after a masked step, or with failure feedback in their state."""
    near = neighbour(steps, [by], [F.col(order)], {"_before": (masked.cast("int"), -1)}, hot=hot)
    return near.withColumn("recovery", (F.coalesce("_before", F.lit(0)) == 1) | F.coalesce(feedback, F.lit(False))).drop("_before")


def sft_report(rows: DataFrame, *, by: list[str], masked: str, length: str, limit: int) -> DataFrame:
    """Kept, masked and dropped rows and the length distribution per split.

    Lengths are integers, so the percentile buffers hold one count per distinct
    length whatever the number of rows.
    """
    kept = F.col(length) <= limit
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(masked) & kept).alias("masked"),
        F.count_if(~F.col(masked) & kept).alias("kept"),
        F.count_if(~kept).alias("dropped_overlong"),
        F.sum(length).alias("total"),
        F.avg(length).alias("mean"),
        *[F.percentile(length, q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)],
        F.max(length).alias("max"),
    )


def split_actions(calls: DataFrame, *, by: list[str], order: str, mode: str = "hybrid", hot: bool | None = None) -> DataFrame:
    """Number the assistant turns: one call each, or (hybrid) adjacent searches together."""
    if mode not in ("single_action", "hybrid"):
        raise ValueError(f"unsupported split mode: {mode}")
    cols = [F.col(order)]
    near = neighbour(calls, by, cols, {"_prev": (F.col("name"), -1)}, hot=hot)
    joins = (F.col("name") == "find_product") & F.coalesce(F.col("_prev") == "find_product", F.lit(False))
    starts = F.lit(1) if mode == "single_action" else F.when(joins, 0).otherwise(1)
    return running(near.withColumn("_s", starts), by, cols, {"turn": ("sum", F.col("_s"))}, upto="current", hot=hot).drop("_prev", "_s")


def turn_transitions(turns: DataFrame, *, by: list[str], order: str, label: str, hot: bool | None = None) -> DataFrame:
    """Counts of label -> next label."""
    near = neighbour(turns, by, [F.col(order)], {"_next": (F.col(label), 1)}, hot=hot)
    return near.filter("_next is not null").groupBy(F.col(label).alias("label"), F.col("_next").alias("next_label")).agg(F.count("*").alias("n"))


def upsample_by_tool(rows: DataFrame, weights: dict[str, int], *, tool: str = "tool") -> DataFrame:
    """Repeat rows by the integer weight of their tool; the copies are numbered from 0."""
    for name, w in weights.items():
        if not name or int(w) < 1:
            raise ValueError(f"weights must be positive integers with a name: {name}={w}")
    weight = F.lit(1)
    for name, w in weights.items():
        weight = F.when(F.col(tool) == name, int(w)).otherwise(weight)
    return rows.withColumn("duplicate_index", F.explode(F.sequence(F.lit(0), weight - 1)))


def sft_rows(steps: DataFrame, *, prompt: str, completion: Column, extra: Column, limit: int) -> DataFrame:
    """Steps as messages with their token length; overlong rows are marked."""
    answer = F.array(F.struct(F.lit("assistant").alias("role"), completion.alias("content")))
    messages = F.concat(F.col(prompt), answer)
    length = F.aggregate(messages, F.lit(0), lambda acc, m: acc + word_count(m["content"]))
    return steps.select(messages.alias("messages"), extra.alias("extra_info"), length.alias("token_length")).withColumn(
        "overlong", F.col("token_length") > limit
    )


def rewrite_state_blocks(df: DataFrame, *, messages: str, replacement: str, system: Column | None = None) -> DataFrame:
    """Replace the text of every state block in user messages, optionally the system prompt.

    ``replacement`` is a regular-expression replacement; ``$1`` is the old state.
    """

    def rewrite(m: Column) -> Column:
        body = F.regexp_replace(m["content"], STATE_BLOCK, f"<state>{replacement}</state>")
        text = F.when(m["role"] == "user", body)
        if system is not None:
            text = text.when(m["role"] == "system", system)
        return F.struct(m["role"].alias("role"), text.otherwise(m["content"]).alias("content"))

    found = F.aggregate(
        F.filter(messages, lambda m: m["role"] == "user"),
        F.lit(0),
        lambda acc, m: acc + F.regexp_count(m["content"], F.lit(STATE_BLOCK)),
    )
    return df.withColumn("state_count", found).withColumn(messages, F.transform(messages, rewrite))


def message_loss_mask(df: DataFrame, *, messages: str, assistant_mask: str | None = None, strict: bool = True) -> DataFrame:
    """0/1 per message: assistant turns carry loss unless their mask says no.

    A system message after the first, an unknown role, or a mask of another
    length than the assistant turns is an error (``strict``) or a reason.
    """
    m = F.col(messages)
    n_assistant = F.size(F.filter(m, lambda x: x["role"] == "assistant"))
    late_system = F.exists(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), lambda x: x["role"] == "system")
    unknown = F.exists(m, lambda x: ~x["role"].isin("system", "user", "assistant", "tool"))
    mask_size = F.size(assistant_mask) if assistant_mask else n_assistant
    reason = (
        F.when(late_system, "system message should be first")
        .when(unknown, "unknown role")
        .when(mask_size != n_assistant, "loss mask does not match the assistant messages")
    )

    def value(x: Column, i: Column) -> Column:
        if not assistant_mask:
            return (x["role"] == "assistant").cast("int")
        before = F.size(F.filter(F.slice(m, F.lit(1), i), lambda y: y["role"] == "assistant"))
        return F.when(x["role"] == "assistant", F.coalesce(F.get(F.col(assistant_mask), before), F.lit(0))).otherwise(0)

    mask = F.transform(m, value)
    out = df.withColumn("mask_error", reason)
    if strict:
        mask = F.when(F.col("mask_error").isNotNull(), F.raise_error(F.col("mask_error")).cast("array<int>")).otherwise(mask)
    else:
        mask = F.when(F.col("mask_error").isNull(), mask)
    return out.withColumn("loss_mask", mask)
