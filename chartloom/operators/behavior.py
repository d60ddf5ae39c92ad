"""Search-behaviour metrics over event logs: descriptive, per episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as X

HELPER_TOOLS = ("fhir_schema", "read_document", "prepare_update")
READ_METHODS = ("GET", "SELECT")


def _outside_strings(sql: Column) -> Column:
    """SQL text in lower case with string literals emptied."""
    return F.lower(F.regexp_replace(sql, r"'(?:[^']|'')*+'", "''"))


def where_literals(sql: Column) -> Column:
    """Literals of the WHERE clause, JSON paths left out."""
    clause = F.regexp_extract(sql, r"(?is)\bwhere\b(.*)$", 1)
    # Cut at the next clause, stepping over literals.
    body = F.regexp_extract(clause, r"(?is)^((?:'(?:[^']|'')*+'|(?!\b(?:group\s+by|having|order\s+by|limit)\b)[^'])*+)", 1)
    strings = F.transform(
        F.regexp_extract_all(body, F.lit(r"'((?:[^']|'')*+)'"), F.lit(1)), lambda s: F.replace(s, F.lit("''"), F.lit("'"))
    )
    numbers = F.regexp_extract_all(F.regexp_replace(body, r"'(?:[^']|'')*+'", ""), F.lit(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])"), F.lit(0))
    return F.filter(F.concat(strings, numbers), lambda s: ~s.startswith("$"))


def filter_values(route: Column, query: Column) -> Column:
    pairs = F.filter(X.query_pairs(query), lambda p: ~p.key.startswith("_") | (p.key == "_id"))
    rest = F.transform(pairs, lambda p: X.after_bar(p.value))
    none = F.array().cast("array<string>")
    values = F.when(route == "rest", rest).when(route == "sql", where_literals(query)).otherwise(none)
    return F.transform(values, X.strip_date_prefix)


def filter_terms(route: Column, query: Column) -> Column:
    """Lexical terms of the filter values of a call, transport controls left out."""
    return X.lexical_terms(F.array_join(filter_values(route, query), " "))


def is_read(e=F.col) -> Column:
    return (
        e("route").isin("rest", "sql") & e("method").isin(*READ_METHODS) & (F.regexp_replace(e("query"), r"^/+|/+$", "") != "metadata")
    )


def is_search(e=F.col) -> Column:
    path = X.url_path(e("query"))
    return is_read(e) & ((e("route") == "sql") | ((path != "") & ~path.contains("/")))


def query_features(events: DataFrame) -> DataFrame:
    """Characters, parameters, predicates and joins of every call."""
    route, query = F.col("route"), F.col("query")
    rest, sql = route == "rest", route == "sql"
    keys = F.transform(X.query_pairs(query), lambda p: p.key)
    n = lambda cond: F.size(F.filter(keys, cond))
    bare = _outside_strings(query)
    columns = F.regexp_extract(bare, r"(?s)^\s*select\s+(?:distinct\s+)?(.*?)\s+from\b", 1)
    flat = F.regexp_replace(F.regexp_replace(columns, r"\([^()]*\)", ""), r"\([^()]*\)", "")
    operators = r"<=|>=|<>|!=|=|<|>|\bin\b|\bis\b|\blike\b"
    return events.select(
        "episode_id",
        "seq",
        F.char_length(query).alias("characters"),
        F.octet_length(query).alias("utf8_bytes"),
        "route",
        F.when(rest, F.size(keys)).alias("parameter_count"),
        F.when(rest, F.size(F.array_distinct(keys))).alias("distinct_parameters"),
        F.when(rest, n(lambda k: ~k.startswith("_") | (k == "_id"))).when(sql, F.regexp_count(bare, F.lit(operators))).alias("predicate_count"),
        F.when(rest, F.coalesce(F.array_max(F.transform(keys, lambda k: F.length(k) - F.length(F.replace(k, F.lit("."), F.lit(""))))), F.lit(0))).alias("chain_depth"),
        F.when(rest, n(lambda k: k.isin("_include", "_revinclude"))).alias("includes"),
        F.when(rest, n(lambda k: k.startswith("_has:"))).alias("reverse_chains"),
        F.when(rest, n(lambda k: k == "date")).alias("temporal_filters"),
        F.when(sql, F.regexp_count(bare, F.lit(r"\bjoin\b"))).alias("joins"),
        F.when(sql, F.regexp_count(bare, F.lit(r"\(\s*select\b"))).alias("subqueries"),
        F.when(sql, F.regexp_count(flat, F.lit(",")) + 1).alias("selected_columns"),
        F.when(sql, bare.rlike(r"\bgroup\s+by\b").cast("int")).alias("group_by"),
    )


def query_feature_stats(events: DataFrame) -> DataFrame:
    """Mean and maximum per episode; episodes without reads get zeros."""
    names = ["characters", "parameter_count", "predicate_count", "chain_depth", "includes", "joins"]
    f = query_features(events.where(F.col("route").isin("rest", "sql") & F.col("method").isin(*READ_METHODS) & (F.col("query") != "metadata")))
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    stats = f.groupBy("episode_id").agg(
        *[F.avg(z(n)).alias(f"query_{n}_mean") for n in names], *[F.max(z(n)).alias(f"query_{n}_max") for n in names]
    )
    every = events.select("episode_id").distinct().join(stats, "episode_id", "left")
    return every.na.fill(0)


def term_first_use(events: DataFrame) -> DataFrame:
    """(episode_id, seq, term) of the filter terms of searches."""
    s = events.where(is_search())
    return s.select("episode_id", "seq", "round", F.explode(filter_terms(F.col("route"), F.col("query"))).alias("term"))


def term_novelty(events: DataFrame, shown: DataFrame, prompts: DataFrame) -> DataFrame:
    """Filter terms not in the prompt nor in any earlier visible response: (episode_id, seq, term).

    ``shown`` has (episode_id, seq, text) of the responses an agent saw, ``prompts`` (episode_id, prompt). A term
    is known from the first response that shows it, so one minimum per term replaces a growing set.
    """
    used = term_first_use(events).select("episode_id", "seq", "term")
    first = (
        shown.select("episode_id", "seq", F.explode(X.lexical_terms(F.col("text"))).alias("term"))
        .groupBy("episode_id", "term").agg(F.min("seq").alias("shown_at"))
    )
    given = prompts.select("episode_id", F.explode(X.lexical_terms(F.col("prompt"))).alias("term")).distinct()
    fresh = used.join(given, ["episode_id", "term"], "left_anti").join(first, ["episode_id", "term"], "left")
    return fresh.where("shown_at is null or shown_at >= seq").select("episode_id", "seq", "term")


def novelty_counts(events: DataFrame, prompts: DataFrame) -> DataFrame:
    """Distinct novel terms per episode from recorded observations; -1 when any search lacks them."""
    s = events.where(is_search())
    recorded = F.col("filter_terms_not_previously_observed")
    state = s.groupBy("episode_id").agg(F.min(recorded.isNotNull().cast("int")).alias("filter_novelty_observed"))
    given = prompts.select("episode_id", F.explode(X.lexical_terms(F.col("prompt"))).alias("term")).distinct()
    terms = s.select("episode_id", F.explode(recorded).alias("term")).distinct().join(given, ["episode_id", "term"], "left_anti")
    counts = terms.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    out = prompts.select("episode_id").distinct().join(state, "episode_id", "left").join(counts, "episode_id", "left")
    ok = F.coalesce("filter_novelty_observed", F.lit(0))
    return out.select(
        "episode_id", F.when(ok == 1, F.coalesce("n", F.lit(0))).otherwise(-1).alias("novel_filter_terms"), ok.alias("filter_novelty_observed")
    )


def search_counts(events: DataFrame) -> DataFrame:
    """Searches, rounds with a search, repeated reads and distinct filter terms per episode."""
    search, read = is_search(), is_read()
    call = F.concat_ws("\u0001", "route", "method", "query")
    base = events.groupBy("episode_id").agg(
        F.count_if(search).alias("search_calls"),
        F.countDistinct(F.when(search, F.col("round"))).alias("search_rounds"),
        (F.count_if(read) - F.countDistinct(F.when(read, call))).alias("repeated_queries"),
    )
    terms = term_first_use(events).groupBy("episode_id").agg(F.countDistinct("term").alias("distinct_filter_terms"))
    return base.join(terms, "episode_id", "left").na.fill(0, ["distinct_filter_terms"])


def opening_action(events: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """What the first call was: a targeted or broad search, or a document read; and the first turn.

    ``tools`` may hold (episode_id, first_tool), the first tool the agent called; without it the first
    event's own tool counts. The first turn is round 1 even when the first event is later.
    """
    e = events.where("route <> 'context'")
    targeted = F.size(filter_terms(F.col("route"), F.col("query"))) > 0
    e = e.withColumn("_search", is_search()).withColumn("_targeted", targeted)
    first = F.min_by(F.struct("via_tool", "method", "query", "_search", "_targeted"), "seq")
    g = e.groupBy("episode_id").agg(
        first.alias("f"), F.max((F.col("_search") & F.col("_targeted") & (F.col("round") == 1)).cast("int")).alias("first_turn_targeted_search")
    )
    tool = F.col("f.via_tool")
    if tools is not None:
        g = g.join(tools, "episode_id", "left")
        tool = F.coalesce("first_tool", "f.via_tool")
    opens = F.col("f._search") & ~F.coalesce(tool.isin(*HELPER_TOOLS), F.lit(False))
    direct = (
        (tool.isNull() | (tool == "fhir_request")) & (F.col("f.method") == "GET")
        & F.col("f.query").startswith("DocumentReference/") & ~F.col("f.query").contains("?")
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return g.select(
        "episode_id",
        flag(opens & F.col("f._targeted")).alias("first_action_targeted_search"),
        flag(opens & ~F.col("f._targeted")).alias("first_action_broad_search"),
        flag((tool == "read_document") | direct).alias("first_action_document_read"),
        "first_turn_targeted_search",
    )


def target_hits(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """(episode_id, seq, resource_hit, fields_hit) for the target evidence of each task."""
    shown = events.select("episode_id", "seq", F.explode("exposed").alias("x")).select("episode_id", "seq", "x.*")
    goal = tasks.select("episode_id", F.explode(F.coalesce("target_evidence", "evidence")).alias("ref"))
    need = tasks.select("episode_id", F.explode("evidence_fields").alias("n")).select("episode_id", F.col("n.ref").alias("ref"), F.col("n.fields").alias("need"))
    goal = goal.join(need, ["episode_id", "ref"], "left")
    j = shown.join(goal, ["episode_id", "ref"])
    whole = F.forall(F.coalesce("need", F.array().cast("array<string>")), lambda n: F.array_contains("fields", n))
    return j.groupBy("episode_id", "seq").agg(F.lit(1).alias("resource_hit"), F.max(whole.cast("int")).alias("fields_hit"))


def hit_flags(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Does the first search, and does the first turn, meet a target and show the fields asked of it?"""
    e = events.withColumn("_search", is_search()).withColumn("_read", is_read())
    j = e.select("episode_id", "seq", "round", "_search", "_read", "refs").join(target_hits(events, tasks), ["episode_id", "seq"], "left").na.fill(0, ["resource_hit", "fields_hit"])
    n = F.when(F.col("_search"), F.col("seq"))
    turn = F.col("_read") & (F.col("round") == 1)
    g = j.groupBy("episode_id").agg(
        F.min_by("resource_hit", n).alias("first_search_gold_resource_hit"),
        F.min_by("fields_hit", n).alias("first_search_required_fields_hit"),
        F.max(F.when(turn, F.col("resource_hit"))).alias("first_turn_gold_resource_hit"),
        F.max(F.when(turn, F.col("fields_hit"))).alias("first_turn_required_fields_hit"),
        F.avg(F.when(F.col("_search"), F.col("resource_hit"))).alias("gold_resource_search_hit_rate"),
    )
    return g.na.fill(0)


def result_volume(events: DataFrame) -> DataFrame:
    """Mean distinct documents per search, as shown and as found."""
    backend = F.coalesce(F.col("backend_refs"), F.col("refs")) if "backend_refs" in events.columns else F.col("refs")
    s = is_search()
    size = lambda c: F.avg(F.when(s, F.size(F.array_distinct(c))))
    return events.groupBy("episode_id").agg(
        F.coalesce(size(F.col("refs")), F.lit(0.0)).alias("unique_resources_per_search_mean"),
        F.coalesce(size(backend), F.lit(0.0)).alias("backend_resources_per_search_mean"),
    )


def token_usage(trajectories: DataFrame, key: str = "task_id") -> DataFrame:
    """Token sums over the model calls of a trajectory; unknown is -1, never zero.

    ``trajectories`` has a key and ``trajectory`` array<struct<response:struct<usage:struct<...>>>>.
    """
    used = F.transform("trajectory", lambda s: s.response.usage)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x != float("inf"))
    known = F.filter(used, lambda u: ok(u.prompt_tokens) & ok(u.completion_tokens))
    total = lambda f: F.aggregate(known, F.lit(0.0), lambda a, u: a + u[f])
    turns = F.coalesce(F.size("trajectory"), F.lit(0))
    complete = (turns > 0) & (F.size(known) == turns)
    inp, out = total("prompt_tokens"), total("completion_tokens")
    known_or = lambda x: F.when(complete, x).otherwise(F.lit(-1.0))
    return trajectories.select(
        key,
        turns.alias("model_turns"),
        complete.cast("int").alias("token_usage_complete"),
        F.when(turns > 0, F.size(known) / turns).otherwise(0.0).alias("token_usage_call_coverage"),
        known_or(inp).alias("model_input_tokens"),
        known_or(out).alias("model_output_tokens"),
        known_or(inp + out).alias("model_total_tokens"),
        inp.alias("observed_model_input_tokens"),
        out.alias("observed_model_output_tokens"),
    )
