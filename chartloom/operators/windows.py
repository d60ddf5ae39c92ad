"""Order-dependent rules over logs, versions and cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import text as X
from chartloom.functions.ranks import join_groups, ranked

BLOCK = 4096


def budget(events: DataFrame, max_calls: int = 40) -> DataFrame:
    """Calls after the first ``max_calls`` of an episode are refused with 429; ``seq`` is the place in the log."""
    over = F.col("seq") > max_calls
    return events.withColumn("status", F.when(over, 429).otherwise(F.col("status"))).withColumn("refused", over)


def attempts(episodes: DataFrame, run: str, task: str, pos: str, correct: Column) -> DataFrame:
    """Example number (by first appearance), attempt number, attempts and correct attempts of every episode."""
    groups = episodes.groupBy(run, task).agg(F.min(pos).alias("_first"), F.count(F.lit(1)).alias("attempts"), F.count_if(correct).alias("correct"))
    examples = ranked(groups, [run], F.floor(F.col("_first") / BLOCK), [F.col("_first")], "example")
    tries = ranked(episodes, [run, task], F.floor(F.col(pos) / BLOCK), [F.col(pos)], "attempt")
    return join_groups(tries, examples.drop("_first"), [run, task])


def version_chain(versions: DataFrame) -> DataFrame:
    """Previous version and body of every version of a document: (ref, version, body, previous_version, previous_body).

    Versions are numbered and joined to the number before, so a much-edited document stays spread out.
    """
    n = ranked(versions, ["ref"], F.floor(F.col("version") / BLOCK), [F.col("version")], "_n")
    prev = n.select("ref", (F.col("_n") + 1).alias("_n"), F.col("version").alias("previous_version"), F.col("body").alias("previous_body"))
    return n.join(prev, ["ref", "_n"], "left").drop("_n")


def version_errors(versions: DataFrame) -> DataFrame:
    """Documents with a version number twice."""
    return versions.groupBy("ref", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# The branches and encodings cases are spread over.
BRANCHES = ("final", "pending", "rejected", "corrected")
ENCODINGS = ("members", "components", "individual")


def balanced_assignment(index: Column) -> Column:
    """Branch rotates by four with a shift per block, encoding changes per block, from a 0-based rank."""
    block = F.floor(index / 4).cast("int")
    turn = (index + block) % 4
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int") + 1)
    return F.struct(
        pick(BRANCHES, turn).alias("lab_branch"), pick(ENCODINGS, block % 3).alias("panel_encoding"),
        ((index + block) % 2 == 1).alias("medication_reference"),
    )


def interleave_strata(patients: DataFrame, band: str, bands: Sequence[str], key: str, per_band: int = 6) -> DataFrame:
    """The first ``per_band`` patients of each band, bands interleaved; fails when a band is too small."""
    w = Window.partitionBy(band).orderBy(key)
    chosen = patients.where(F.col(band).isin(list(bands))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_band)
    place = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col(band))
    size = len(bands) * per_band
    out = chosen.withColumn("cohort_pos", ((F.col("_rn") - 1) * len(bands) + place).cast("int")).drop("_rn")
    if out.count() != size:
        raise ValueError(f"need at least {per_band} patients in each band")
    return out


def discovery_audit(steps: DataFrame, prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Ids and identifiers a read uses that neither the prompt nor an earlier response shows: (task_id, step, used).

    steps (task_id, step, method, path), prompts (task_id, prompt), responses (task_id, step, text). Reads after
    the first write are not audited.
    """
    writes = steps.where("method <> 'GET'").groupBy("task_id").agg(F.min("step").alias("_write"))
    reads = steps.join(writes, "task_id", "left").where("_write is null or step < _write")
    pairs = F.filter(X.query_pairs(F.col("path")), lambda p: p.key == "identifier")
    ids = F.array_union(X.hex_ids(F.col("path")), F.transform(pairs, lambda p: X.after_bar(p.value)))
    used = reads.select("task_id", "step", F.explode(ids).alias("used")).distinct()
    seen = prompts.select("task_id", F.lit(-1).alias("_at"), F.col("prompt").alias("_text")).unionByName(
        responses.select("task_id", F.col("step").alias("_at"), F.col("text").alias("_text"))
    )
    known = used.join(seen, "task_id").where((F.col("_at") < F.col("step")) & F.col("_text").contains(F.col("used")))
    return used.join(known.select("task_id", "step", "used").distinct(), ["task_id", "step", "used"], "left_anti")
