"""The state machine of blocks, its logs, and what is counted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states that may follow each one; every state may also follow itself.
_NEXT = {"REGISTERED": "TRANSLATED", "TRANSLATED": "PENDING", "PENDING": "FORCE_FIT OPTIMAL OVERFLOW REWRITE_SCHEDULED UNDERFLOW", "OVERFLOW": "FORCE_FIT OPTIMAL PENDING REWRITE_SCHEDULED", "UNDERFLOW": "FORCE_FIT OPTIMAL PENDING REWRITE_SCHEDULED", "REWRITE_SCHEDULED": "FORCE_FIT OPTIMAL PENDING", "OPTIMAL": "", "FORCE_FIT": ""}
ALLOWED = {state: (state, *following.split()) for state, following in _NEXT.items()}
STABLE = ("OPTIMAL", "FORCE_FIT")
_EDGES = tuple(f"{a}>{b}" for a, bs in ALLOWED.items() for b in bs)


def replay(requests: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Requests (lid, seq, status, round, and optionally force) with from_state and accepted.

    A block begins REGISTERED. A request is accepted if the matrix has the step or force
    holds; else the state stays. Requests without lid or with an unknown status are left
    out of the log. One fold for each block, over its requests in order of seq.
    """
    force = F.col("force") if "force" in requests.columns else F.lit(False)
    rows = requests.where(F.col("lid").isNotNull() & F.col("status").isin(*ALLOWED)).select("lid", F.struct("seq", "status", "round", force.alias("force"), *extra).alias("r"))
    edges = F.array(*map(F.lit, _EDGES))
    start = F.struct(F.lit("REGISTERED").alias("state"), F.array().cast("array<struct<from_state:string,accepted:boolean>>").alias("log"))

    def step(s, r):
        ok = r["force"] | F.array_contains(edges, F.concat(s["state"], F.lit(">"), r["status"]))
        return F.struct(F.when(ok, r["status"]).otherwise(s["state"]).alias("state"), F.concat(s["log"], F.array(F.struct(s["state"].alias("from_state"), ok.alias("accepted")))).alias("log"))

    folded = rows.groupBy("lid").agg(F.array_sort(F.collect_list("r")).alias("rs")).withColumn("log", F.aggregate("rs", start, step)["log"])
    flat = folded.select("lid", F.inline(F.arrays_zip("rs", "log"))).select("lid", "rs.*", "log.*")
    return flat.withColumnRenamed("status", "to_state").drop("force")


def final_states(log: DataFrame) -> DataFrame:
    """The state of each block after its log, with the round of the last accepted step and the counts."""
    last = F.struct("seq")
    ok = F.col("accepted")
    return log.groupBy("lid").agg(F.coalesce(F.max_by("to_state", F.when(ok, last)), F.lit("REGISTERED")).alias("state"), F.coalesce(F.max_by("round", F.when(ok, last)), F.lit(0)).cast("long").alias("round"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def skippable(states: DataFrame, current_round: int) -> DataFrame:
    """Blocks that a round may skip: stable ones that settled before it."""
    return states.where(F.col("state").isin(*STABLE) & (F.col("round") < current_round))


def round_summary(log: DataFrame) -> DataFrame:
    """For each round: blocks that moved, and accepted steps by kind."""
    return log.where("accepted").groupBy("round").agg(F.count_distinct("lid").alias("processed"), F.count("*").alias("steps"), F.count_if(F.col("to_state").isin(*STABLE)).alias("settled"))


def round_counts(log: DataFrame, actions: DataFrame) -> DataFrame:
    """round, kind, name, n: what happened in each round, by action, issue, result (state reached) and transition.

    log: replay(); actions: lid, seq, round, actions, issue. Refused steps are no results.
    """
    moved = log.where("accepted")
    parts = [
        actions.select("round", F.lit("action").alias("kind"), F.explode("actions").alias("name")),
        actions.where("issue is not null").select("round", F.lit("issue").alias("kind"), F.col("issue").alias("name")),
        moved.select("round", F.lit("result").alias("kind"), F.col("to_state").alias("name")),
        moved.select("round", F.lit("transition").alias("kind"), F.concat_ws("->", "from_state", "to_state").alias("name")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.groupBy("round", "kind", "name").agg(F.count("*").alias("n"))


def attribution(actions: DataFrame) -> DataFrame:
    """Counts over an action log: kind (stage, action or issue), name, n. A missing stage counts as unknown."""
    stage = actions.select(F.lit("stage").alias("kind"), F.coalesce("stage", F.lit("unknown")).alias("name"))
    action = actions.select(F.lit("action").alias("kind"), F.explode(F.array_distinct("actions")).alias("name"))
    issue = actions.where("issue is not null").select(F.lit("issue").alias("kind"), F.col("issue").alias("name"))
    return stage.unionByName(action).unionByName(issue).groupBy("kind", "name").agg(F.count("*").alias("n"))


def registry(blocks: DataFrame) -> DataFrame:
    """Each paragraph as REGISTERED with the type and page of its last block."""
    return blocks.where("lid is not null").groupBy("doc_id", "lid").agg(F.max_by("type", "idx").alias("type"), F.max_by("page_idx", "idx").alias("page_idx")).withColumn("state", F.lit("REGISTERED"))


EVENT_COLUMNS = ("lid", "round", "stage", "event_type", "state_before", "state_after", "planned_actions", "applied_actions", "issue")


def events(rows: DataFrame, stage: str, event_type: str) -> DataFrame:
    """Rows as events of a stage, in EVENT_COLUMNS; actions once each, in order. Missing columns are NULL."""
    nothing = {c: F.lit(None).cast("array<string>" if c.endswith("actions") else "int" if c == "round" else "string") for c in EVENT_COLUMNS if c not in rows.columns}
    full = rows.withColumns(nothing).withColumns({"stage": F.lit(stage), "event_type": F.lit(event_type)})
    once = {c: F.coalesce(F.array_distinct(c), F.array().cast("array<string>")) for c in ("planned_actions", "applied_actions")}
    return full.withColumns(once).select(*EVENT_COLUMNS)


def rewrite_delta(rows: DataFrame) -> DataFrame:
    """chars_before, chars_after and their difference for rewritten texts (before_text, after_text)."""
    r = rows.withColumns({"chars_before": F.length(F.coalesce("before_text", F.lit(""))), "chars_after": F.length(F.coalesce("after_text", F.lit("")))})
    return r.withColumn("delta", F.col("chars_after") - F.col("chars_before"))
