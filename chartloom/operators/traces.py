"""Stored evaluation episodes: outcomes, turns, usage and run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.ranks import running_total

BLOCK = 4096


def outcome_of(failed: Column, successes: Column) -> Column:
    """Error before everything; Unscored unless every trace has 0 or 1; Correct when all are 1."""
    scored = (F.size(successes) > 0) & F.forall(successes, lambda s: F.coalesce(s.isin(0.0, 1.0), F.lit(False)))
    return (
        F.when(failed, "Error").when(~scored, "Unscored").when(F.forall(successes, lambda s: s == 1), "Correct").otherwise("Incorrect")
    )


def outcome() -> Column:
    """Outcome of an episode row; rewards are never looked at."""
    broken = lambda ok, errors: F.coalesce(~ok, F.lit(False)) | (F.coalesce(F.size(errors), F.lit(0)) > 0)
    failed = broken(F.col("ok"), F.col("errors")) | F.coalesce(F.exists("traces", lambda t: broken(t.ok, t.errors)), F.lit(False))
    value = lambda t: F.when(
        F.map_contains_key(t.metrics, "workflow_success"), F.try_element_at(t.metrics, F.lit("workflow_success"))
    ).otherwise(F.try_element_at(t.metrics, F.lit("strict_success")))
    return outcome_of(failed, F.transform("traces", value))


def episode_metric(name: str) -> Column:
    """Least value over the traces, NULL when any trace lacks it."""
    values = F.transform("traces", lambda t: F.try_element_at(t.metrics, F.lit(name)))
    known = (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(known, F.array_min(values))


def usage() -> Column:
    """Model calls and output tokens; tokens are NULL when any call does not state them."""
    calls = F.flatten(F.transform("traces", lambda t: F.coalesce(t.calls, F.array().cast(
        "array<struct<model:string,usage:struct<prompt_tokens:double,completion_tokens:double>>>"))))
    out = F.transform(calls, lambda c: c.usage.completion_tokens)
    known = (F.size(out) > 0) & F.forall(out, lambda x: F.coalesce(x >= 0, F.lit(False)))
    return F.struct(F.size(calls).alias("calls"), F.when(known, F.aggregate(out, F.lit(0.0), lambda a, x: a + x)).alias("output_tokens"))


def task_key() -> Column:
    return F.coalesce(F.nullif("task.key", F.lit("")), F.nullif("id", F.lit("")), F.lit("unnamed"))


def family_label(*sources: Column) -> Column:
    """First family named by the sources, underscores as spaces, else Task."""
    return F.replace(F.coalesce(*[F.nullif(s, F.lit("")) for s in sources], F.lit("Task")), F.lit("_"), F.lit(" "))


def explode_nodes(episodes: DataFrame) -> DataFrame:
    """One row per message: (episode_id, trace, pos, sampled, role, content, reasoning_content, name, tool_call_id, tool_calls)."""
    t = episodes.select(F.col("id").alias("episode_id"), F.posexplode("traces").alias("trace", "t"))
    n = t.select("episode_id", "trace", F.posexplode("t.nodes").alias("pos", "n"))
    return n.select("episode_id", "trace", "pos", F.col("n.sampled").alias("sampled"), "n.message.*")


def turn_table(nodes: DataFrame) -> DataFrame:
    """Messages from the first sampled assistant turn on, with their turn number; prompt examples are left out."""
    is_turn = (F.col("role") == "assistant") & F.coalesce("sampled", F.lit(False))
    keys = ["episode_id", "trace"]
    t = running_total(nodes.withColumn("is_turn", is_turn), keys, F.floor(F.col("pos") / BLOCK), [F.col("pos")], is_turn.cast("int"), "turn")
    kept = (F.col("turn") > 0) & (F.col("is_turn") | F.col("role").isin("tool", "user"))
    return t.where(kept)


def call_result_pairs(nodes: DataFrame) -> DataFrame:
    """Tool calls beside their results by call id, inside a trace; calls without a result are kept."""
    calls = nodes.where("role = 'assistant'").select("episode_id", "trace", F.col("pos").alias("call_pos"), F.explode("tool_calls").alias("c")).select(
        "episode_id", "trace", "call_pos", F.col("c.id").alias("tool_call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments")
    )
    results = nodes.where("role = 'tool'").select("episode_id", "trace", "tool_call_id", F.col("pos").alias("result_pos"), F.col("content").alias("result"))
    return calls.join(results, ["episode_id", "trace", "tool_call_id"], "left")


def final_answers(nodes: DataFrame) -> DataFrame:
    """Text of the last sampled assistant message of each trace."""
    said = nodes.where(F.coalesce("sampled", F.lit(False)) & (F.col("role") == "assistant"))
    return said.groupBy("episode_id", "trace").agg(F.max_by("content", "pos").alias("final"))


def prompt_text(prompt_v: Column) -> Column:
    """A prompt kept as text, or as a list of messages, as one text."""
    kind = F.schema_of_variant(prompt_v)
    content = lambda c: F.when(F.schema_of_variant(c) == "STRING", c.try_cast("string")).when(
        F.schema_of_variant(c).startswith("ARRAY"),
        F.array_join(F.transform(c.try_cast("array<variant>"), lambda p: F.coalesce(
            F.try_variant_get(p, "$.text", "string"),
            F.concat(F.lit("["), F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("content")), F.lit(" attachment]")))), "\n"),
    ).otherwise("")
    parts = F.transform(
        prompt_v.try_cast("array<variant>"),
        lambda m: F.concat(F.lit("["), F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("unknown")), F.lit("]\n"),
                           F.coalesce(content(F.try_variant_get(m, "$.content", "variant")), F.lit(""))),
    )
    return F.when(kind == "STRING", prompt_v.try_cast("string")).when(kind.startswith("ARRAY"), F.array_join(parts, "\n\n"))


def outcome_counts(outcomes: DataFrame, run: str) -> DataFrame:
    """Correct, Incorrect, Error and Unscored episodes of each run."""
    return outcomes.groupBy(run).pivot("outcome", ["Correct", "Incorrect", "Error", "Unscored"]).agg(F.count(F.lit(1))).na.fill(0)


def solved_examples(outcomes: DataFrame, run: str, task: str) -> DataFrame:
    """Examples of each run and those with at least one correct attempt."""
    per = outcomes.groupBy(run, task).agg(F.max((F.col("outcome") == "Correct").cast("int")).alias("s"))
    return per.groupBy(run).agg(F.count(F.lit(1)).alias("examples"), F.sum("s").alias("solved"))


def run_means(traces: DataFrame, run: str) -> DataFrame:
    """(run, metric, mean, missing): negatives count as missing."""
    m = traces.select(run, F.explode("metrics").alias("metric", "value"))
    return m.groupBy(run, "metric").agg(
        F.avg(F.when(F.col("value") >= 0, F.col("value"))).alias("mean"), F.count_if(F.col("value") < 0).alias("missing")
    )


def weighted_reward(rewards: Column) -> Column:
    """Sum of score times weight over the rewards that have a score; NULL when none has."""
    scored = F.filter(F.map_values(rewards), lambda r: r.score.isNotNull())
    total = F.aggregate(scored, F.lit(0.0), lambda a, r: a + r.score * F.coalesce(r.weight, F.lit(1.0)))
    return F.when(F.size(scored) > 0, total)


def run_status(receipts: DataFrame) -> DataFrame:
    """State of each run from its receipts: (run, finished_status, prepare_failed, gpu, gpu_status, gpu_error, gpu_elapsed,
    prepared_status, num_examples, rollouts_per_example, plan_model, call_model)."""
    c = F.col
    state = (
        F.when(c("finished_status") == "completed", "Completed")
        .when((c("finished_status") == "failed") | c("prepare_failed"), "Failed")
        .when(c("gpu_status") == "completed", "Evaluation completed; reporting pending")
        .when(c("gpu_error").isNotNull() | ((c("gpu_status") == "failed") & c("gpu_elapsed").isNotNull()), "GPU stage failed")
        .when(c("gpu"), "GPU stage started; final outcome not recorded")
        .when(c("prepared_status") == "prepared", "Prepared; no GPU outcome recorded")
        .otherwise("Submitted; no preparation outcome recorded")
    )
    requested = F.col("num_examples") * F.coalesce("rollouts_per_example", F.lit(1))
    return receipts.select(
        "run", state.alias("state"), F.when(requested > 0, requested).alias("requested"), F.coalesce("plan_model", "call_model", F.lit("Unknown")).alias("model"),
        F.regexp_extract("run", r"(\d{8}-\d{6}Z)", 1).alias("submitted"),
    )


def complete_runs(plans: DataFrame, episodes: DataFrame) -> DataFrame:
    """Accept a batch only when every run is completed and episodes = examples x rollouts = receipt count.

    plans (run, status, num_examples, rollouts_per_example, receipt_episodes), episodes (run, ...).
    """
    n = episodes.groupBy("run").agg(F.count(F.lit(1)).alias("found"))
    j = plans.join(n, "run", "left").na.fill(0, ["found"])
    wanted = F.col("num_examples") * F.coalesce("rollouts_per_example", F.lit(1))
    ok = (F.col("status") == "completed") & (F.col("found") > 0) & (F.col("found") == wanted) & (F.col("found") == F.col("receipt_episodes"))
    return j.select("run", "found", F.coalesce(ok, F.lit(False)).alias("complete"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues by side and severity, and documents with errors: one row per side."""
    return issues.groupBy("side").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("fatal", "error", "warning", "information")],
        F.countDistinct(F.when(F.col("severity").isin("fatal", "error"), F.col("resource"))).alias("resources_with_errors"),
    )


def message_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("side", "severity", "message").agg(F.count(F.lit(1)).alias("n"))
