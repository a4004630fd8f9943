"""Trajectories of two dialects as events and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text
from runloom.functions.recovery import recover_json, sorted_json
from runloom.operators.events import seconds

_get = F.get_json_object


def _num(c: Column, path: str, kind: str = "double") -> Column:
    return _get(c, path).try_cast(kind)


METRICS = ["steps", "cost", "exit_status", "submission_length", "files_touched", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]


def parsed(samples: DataFrame, column: str = "trajectory") -> DataFrame:
    """Adds truncated, info (JSON text), messages (array of JSON text) and dialect.

    The first message that has parts or a role tells the dialect; without one the header's
    keys do. A header with a cost or tokens alone counts as opencode, one with model_stats as
    mini; anything else is unknown.
    """
    d = samples.withColumn("_r", recover_json(F.col(column))).select("*", "_r.truncated", "_r.info", "_r.messages").drop("_r")
    kind = lambda m: F.when(_get(m, "$.parts").isNotNull() | _get(m, "$.info.role").isNotNull(), "opencode").when(_get(m, "$.role").isNotNull(), "mini")
    told = F.try_element_at(F.filter(F.transform("messages", kind), lambda k: k.isNotNull()), F.lit(1))
    session = F.coalesce(*[_get("info", f"$.{k}") for k in ("model_stats.step_count", "projectID", "sessionID", "slug", "directory")]).isNotNull()
    opencode = F.coalesce(told, F.when(session, "opencode"), F.lit("")) == "opencode"
    priced_header = F.coalesce(_get("info", "$.cost"), _get("info", "$.tokens")).isNotNull()
    return d.withColumn("dialect", F.when(opencode, "opencode").when(_get("info", "$.model_stats").isNotNull(), "mini").when(priced_header, "opencode").otherwise("unknown"))


def _total(path: str) -> Column:
    n = F.transform("messages", lambda m: F.coalesce(_num(m, path, "long"), F.lit(0).cast("long")))
    return F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)


def _first_number(*paths: str) -> Column:
    """The first of the header's numbers that isn't missing or 0."""
    return F.coalesce(*[F.nullif(_num(F.col("info"), p), F.lit(0.0)) for p in paths], F.lit(0.0))


def metrics(t: DataFrame, patch: str = "patch") -> DataFrame:
    """Adds METRICS by dialect, with the rates of a priced model where no cost was logged.

    A cut trajectory's exit status is truncated, a missing one unknown. Steps are the header's
    count, else step-start parts (opencode) or assistant turns. files_touched are paths in
    the shell blocks of mini's messages; of a cut trajectory, or of another dialect, the files
    of the patch, if there is such a column. An unknown dialect has zeros.
    """
    open_, mini = F.col("dialect") == "opencode", F.col("dialect") == "mini"
    zero = F.lit(0).cast("long")
    by = lambda o, m: F.when(open_, o).when(mini, m).otherwise(zero)
    turns = lambda path: F.size(F.filter("messages", lambda m: F.coalesce(_get(m, path) == "assistant", F.lit(False)))).cast("long")
    starts = F.aggregate(F.transform("messages", lambda m: F.size(F.filter(F.coalesce(F.from_json(_get(m, "$.parts"), "array<struct<type:string>>"), F.array().cast("array<struct<type:string>>")), lambda p: F.coalesce(p["type"] == "step-start", F.lit(False))))), F.lit(0), lambda a, x: a + x).cast("long")
    calls = _num(F.col("info"), "$.model_stats.api_calls").cast("long")
    number = lambda path: F.coalesce(_num(F.col("info"), path, "long"), zero)
    usage = "$.extra.response.usage"
    own = F.flatten(F.transform(F.filter("messages", lambda m: F.coalesce(_get(m, "$.role") == "assistant", F.lit(False))), lambda m: text.files_touched(_get(m, "$.content"))))
    in_patch = F.coalesce(F.size(text.patch_files(F.col(patch))), F.lit(0)) if patch in t.columns else F.lit(0)
    t = t.withColumns(
        {
            "steps": by(F.coalesce(_num(F.col("info"), "$.model_stats.step_count", "long"), F.when(starts > 0, starts), turns("$.info.role")), F.when(calls > 0, calls).otherwise(turns("$.role"))),
            "exit_status": F.when(F.col("truncated"), "truncated").when(open_, "ok").when(mini, F.coalesce(_get("info", "$.exit_status"), F.lit("unknown"))).otherwise("unknown"),
            "submission_length": F.when(mini, F.coalesce(F.length(_get("info", "$.submission")), F.lit(0))).otherwise(0),
            "files_touched": F.when(mini & ~F.col("truncated"), F.size(F.array_distinct(own))).otherwise(in_patch),
            "input_tokens": by(number("$.tokens.input"), _total(f"{usage}.prompt_tokens")),
            "output_tokens": by(number("$.tokens.output"), _total(f"{usage}.completion_tokens")),
            "cache_read_tokens": by(number("$.tokens.cache.read"), _total(f"{usage}.prompt_tokens_details.cached_tokens")),
            "cache_write_tokens": by(number("$.tokens.cache.write"), _total(f"{usage}.cache_creation_input_tokens")),
            "reasoning_tokens": by(number("$.tokens.reasoning"), zero),
            "model": F.coalesce(_get("info", "$.model.id"), F.when(~_get("info", "$.model").startswith("{"), _get("info", "$.model")), _get("info", "$.config.model.model_name"), _get("info", "$.config.model.model_name_or_path")),
        }
    )
    priced_in = F.when(open_, _first_number("$.tokens.input", "$.tokens.input_tokens", "$.tokens.prompt_tokens")).otherwise(F.coalesce(F.nullif(F.col("input_tokens").cast("double"), F.lit(0.0)), _first_number("$.model_stats.prompt_tokens")))
    priced_out = F.when(open_, _first_number("$.tokens.output", "$.tokens.output_tokens", "$.tokens.completion_tokens")).otherwise(F.coalesce(F.nullif(F.col("output_tokens").cast("double"), F.lit(0.0)), _first_number("$.model_stats.completion_tokens")))
    logged = F.when(open_, _num(F.col("info"), "$.cost")).when(mini, _num(F.col("info"), "$.model_stats.instance_cost"))
    cost = priced(F.coalesce(logged, F.lit(0.0)), F.col("model"), priced_in, priced_out)
    return t.withColumn("cost", F.when(open_ | mini, cost).otherwise(0.0))


def model_metadata(t: DataFrame) -> DataFrame:
    """Adds a struct `metadata`: model, provider, cost, api_calls, tokens (JSON text) and exit_status, as each dialect's header has them."""
    mini = F.col("dialect") == "mini"
    of = lambda m, o: F.when(mini, m).otherwise(o)
    null = F.lit(None).cast("string")
    fields = {
        "model": of(_get("info", "$.config.model.model_name"), F.coalesce(_get("info", "$.model.id"), _get("info", "$.model.modelID"))),
        "provider": of(null, _get("info", "$.model.providerID")),
        "cost": of(_num(F.col("info"), "$.model_stats.instance_cost"), _num(F.col("info"), "$.cost")),
        "api_calls": F.when(mini, _num(F.col("info"), "$.model_stats.api_calls", "long")),
        "tokens": of(null, _get("info", "$.tokens")),
        "exit_status": of(_get("info", "$.exit_status"), null),
    }
    return t.withColumn("metadata", F.struct(*[c.alias(n) for n, c in fields.items()]))


#: The price of a million tokens, in and out, for models that log no cost.
RATES = {"qwen": (0.285, 2.4)}


def priced(cost: Column, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    out = cost
    for name, (a, b) in RATES.items():
        out = F.when((cost == 0) & F.contains(F.lower(F.coalesce(model, F.lit(""))), F.lit(name)), (tokens_in * a + tokens_out * b) / 1e6).otherwise(out)
    return out


def events(t: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each message, or part of a message: case, event_idx, id (E0, E1, ...), role, kind, content, tool, times.

    A mini message lasts until the next one, unless time runs back; the last has no duration.
    The parts of an opencode message share its time evenly, which is then an estimate.
    """
    opencode = F.col("dialect") == "opencode"
    own = F.when(opencode, F.transform("messages", lambda m: F.coalesce(F.filter(F.from_json(_get(m, "$.parts"), "array<string>"), lambda x: x.startswith("{")), F.array().cast("array<string>")))).otherwise(F.transform("messages", lambda m: F.array(m)))
    said = F.transform(
        "messages",
        lambda m: F.struct(
            F.when(opencode, _get(m, "$.info.role")).otherwise(_get(m, "$.role")).alias("role"),
            seconds(F.when(opencode, _num(m, "$.info.time.created")).otherwise(_num(m, "$.timestamp"))).alias("timestamp"),
            F.when(opencode, seconds(_num(m, "$.info.time.completed"))).alias("completed"),
        ),
    )
    e = t.select(case, "dialect", own.alias("_own"), said.alias("_said"))
    at = lambda i: F.get("_said", i)
    piece = lambda i, j, x, n: F.struct(i.alias("message_index"), j.alias("part_index"), x.alias("p"), n.alias("n"), at(i).alias("said"), at(i + 1)["timestamp"].alias("next"))
    # a trajectory is one row, so its events are numbered there, in one pass without a shuffle
    e = e.select(case, "dialect", F.posexplode(F.flatten(F.transform("_own", lambda parts, i: F.transform(parts, lambda x, j: piece(i, j, x, F.size(parts)))))).alias("event_idx", "_e"))
    e = e.select(case, "dialect", "event_idx", "_e.*").select("*", "said.*").drop("said")
    plain = F.col("dialect") != "opencode"
    kind = F.coalesce(_get("p", "$.type"), F.lit("unknown"))
    tool, given, out = F.coalesce(_get("p", "$.tool"), F.lit("unknown")), _get("p", "$.state.input"), _get("p", "$.state.output")
    is_tool = ~plain & (kind == "tool")
    given, out = F.when(is_tool, given), F.when(is_tool, out)
    body = F.concat_ws("\n", F.concat(F.lit("TOOL: "), tool), F.when(given.isNotNull() & ~given.isin("", "{}"), F.concat(F.lit("INPUT:\n"), sorted_json(given))), F.when(out != "", F.concat(F.lit("OUTPUT:\n"), sorted_json(out))))
    only = lambda c: F.when(is_tool, c)
    gap, took = F.col("next") - F.col("timestamp"), F.col("completed") - F.col("timestamp")
    return e.select(
        case, "message_index", "part_index", F.coalesce("role", F.lit("unknown")).alias("role"), F.when(plain, "message").otherwise(kind).alias("kind"),
        F.when(plain, F.coalesce(_get("p", "$.content"), F.lit(""))).when(is_tool, body).otherwise(F.coalesce(_get("p", "$.text"), F.lit(""))).alias("content"),
        only(tool).alias("tool_name"), only(_get("p", "$.state.status")).alias("tool_status"), only(given).alias("tool_input"), only(out).alias("tool_output"), "timestamp",
        (~plain & F.coalesce(took >= 0, F.lit(False)) & (F.col("n") > 1)).alias("duration_is_estimated"), "event_idx", F.concat(F.lit("E"), F.col("event_idx")).alias("id"),
        F.when(plain, F.when(gap >= 0, gap)).when(took >= 0, took / F.col("n")).alias("duration_seconds"),
    )
