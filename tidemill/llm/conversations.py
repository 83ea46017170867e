"""Conversations rebuilt from message rows by parent pointers.

``resolve_parents`` takes nodes with parent pointers and finds each node's root and depth by pointer
jumping: in every round a node takes over the pointer of the node it points to, so the covered
distance doubles and a chain of n nodes needs log2(n) joins. Nodes whose chain ends at a parent that
does not exist are orphans; nodes still under way after enough rounds for the longest possible chain
run in a cycle. ``root_to_leaf_paths`` expands ordered paths from the rounds' own jump tables.

Transcripts carry no pointers: the parent of a usable message is the usable message before it in
order of instants. Messages of an hour are contracted to a run first, whose parent is the run
before, so only runs jump, and a session that holds a third of all rows is spread over its runs: they
meet by day, and only the ends of days meet by session. A usable message without a real time has no
place in the order and its parent is unknown: its node points to a parent that does not exist, comes out
as an orphan, and breaks its conversation. The turns of sound conversations are the root-to-leaf paths
of their runs, each run in order of instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.messages import HEARTBEAT, distinct_lines, is_blank
from tidemill.sources.tables import kept_table

#: width of the runs that are contracted before pointers jump
RUN_US = 3600 * 1_000_000
DAY_US = 24 * 3600 * 1_000_000


def resolve_parents(nodes: DataFrame, keep_jumps: list[DataFrame] | None = None) -> DataFrame:
    """(id, root, depth, state) of ``nodes`` (id string, parent string, weight bigint).

    ``weight`` is the distance from a node to its parent. ``state`` is ``ok``, ``orphan`` (the chain
    ends at a parent that is no node; ``root`` is the last node met) or ``cycle`` (``root`` and
    ``depth`` are null; so also for what hangs below a cycle). Rows with a null id are left out, and
    of repeated ids one row is kept. ``keep_jumps`` collects each round's table (id, ptr).

    A round writes the nodes that are still under way, and those only: nodes that have met their root
    stay where they were written.
    """
    nodes = nodes.where("id is not null").dropDuplicates(["id"]).select("id", "parent", "weight")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    state = kept_table(
        nodes.join(known, "parent", "left").select(
            "id",
            F.when(F.col("known"), F.col("parent")).alias("ptr"),
            F.when(F.col("known"), F.col("weight")).otherwise(F.lit(0)).cast("bigint").alias("dist"),
            F.when(F.col("parent").isNotNull() & F.col("known").isNull(), "orphan").otherwise("ok").alias("state"),
            F.when(F.col("known").isNull(), F.col("id")).alias("root"),
        )
    )
    total, left = state.agg(F.count(F.lit(1)), F.count("ptr")).first()
    done, active = state.where("ptr is null"), state.where("ptr is not null")
    covered = 1
    while left and covered <= 2 * total:
        if keep_jumps is not None:
            keep_jumps.append(active.select("id", "ptr"))
        target = done.unionByName(active).select(
            F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"),
            F.col("state").alias("state2"), F.col("root").alias("root2"),
        )
        moved = kept_table(
            active.join(target, "ptr").select(
                "id", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"),
                F.col("state2").alias("state"), F.col("root2").alias("root"),
            )
        )
        covered *= 2
        left = moved.where("ptr is not null").count()
        done, active = done.unionByName(moved.where("ptr is null")), moved.where("ptr is not null")
    cycles = active.select("id", F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("depth"), F.lit("cycle").alias("state"))
    return done.select("id", "root", F.col("dist").alias("depth"), "state").unionByName(cycles)


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, id, depth): for every leaf that hangs on a root, its ancestors and itself; ``depth`` is the distance from the root.

    Ancestors come from the jump tables of the rounds: each distance is one sum of powers of two, so
    every ancestor is reached exactly once and the work is the size of the result. Orphans and
    cycles have no path.
    """
    jumps: list[DataFrame] = []
    found = resolve_parents(nodes, jumps).where("state = 'ok'")
    parents = nodes.where("parent is not null").select(F.col("parent").alias("id"))
    leaves = found.join(parents, "id", "left_anti")
    path = leaves.select(F.col("id").alias("leaf"), "id")
    for jump in reversed(jumps):
        path = kept_table(path.unionByName(path.join(jump, "id").select("leaf", F.col("ptr").alias("id"))))
    return path.join(found.select("id", "depth"), "id").select("leaf", "id", "depth")


def _usable(role: Column, text: Column) -> Column:
    return role.isin("user", "assistant") & ~is_blank(text) & ~text.contains(HEARTBEAT)


def usable_lines(messages: DataFrame) -> DataFrame:
    """Each line once: (session_id, line_num, us, role, usable); ``role`` is user, assistant or null for any other."""
    role = F.lower(F.regexp_replace(F.col("role"), r"(?U)^\s+|\s+$", ""))
    usable = F.coalesce(_usable(role, F.col("text")), F.lit(False))
    code = F.when(role == "user", 2).when(role == "assistant", 4).otherwise(0) + usable.cast("int")
    said = F.col("code").bitwiseAND(6)
    return distinct_lines(messages, code).select(
        "session_id", "line_num", "us", F.when(said == 2, "user").when(said == 4, "assistant").alias("role"),
        (F.col("code").bitwiseAND(1) == 1).alias("usable"),
    )


def _runs(lines: DataFrame) -> DataFrame:
    """The runs of an hour, and one of all that has no time: (session_id, run, first_role, last_role, n).

    A run's first and last role are found by one long each: the time in the run (32 bits), the line (30), the role.
    """
    run = F.floor(F.col("us") / RUN_US)
    at = F.shiftleft(F.col("us") - run * RUN_US, 31).bitwiseOR(F.shiftleft(F.coalesce("line_num", F.lit(0)).cast("bigint"), 1))
    place = at.bitwiseOR((F.col("role") == "assistant").cast("bigint"))
    role = lambda c: F.when(F.col(c).bitwiseAND(1) == 1, "assistant").otherwise("user")
    return (
        lines.where("usable").select("session_id", run.alias("run"), place.alias("place")).groupBy("session_id", "run")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n"))
        .select("session_id", "run", role("first").alias("first_role"), role("last").alias("last_role"), "n")
    )


def _key(session: Column, run: Column) -> Column:
    return F.concat_ws("#", session, run.cast("string"))


def run_nodes(runs: DataFrame) -> DataFrame:
    """The runs with pointers: (id, parent, weight, session_id, run, first_role, last_role, n).

    A run's parent is the run before in its session, and its weight that run's size. Runs are ordered
    by day, and the first of a day is given the last of the day before that has one. What has no time
    points to a parent that no run is.
    """
    session = F.col("session_id")
    day = F.floor(F.col("run") * RUN_US / DAY_US).cast("bigint")
    timed = runs.where("run is not null").withColumn("day", day)
    days = timed.groupBy("session_id", "day").agg(F.max("run").alias("end_run"), F.max_by("n", "run").alias("end_n"))
    before = Window.partitionBy("session_id").orderBy("day")
    days = days.select("session_id", "day", F.lag("end_run").over(before).alias("day_run"), F.lag("end_n").over(before).alias("day_n"))
    inside = Window.partitionBy("session_id", "day").orderBy("run")
    linked = timed.select("*", F.lag("run").over(inside).alias("prev_run"), F.lag("n").over(inside).alias("prev_n")).join(days, ["session_id", "day"])
    prev, weight = F.coalesce("prev_run", "day_run"), F.coalesce("prev_n", "day_n")
    own = ["session_id", "run", "first_role", "last_role", "n"]
    nodes = linked.select(_key(session, F.col("run")).alias("id"), F.when(prev.isNotNull(), _key(session, prev)).alias("parent"), weight.alias("weight"), *own)
    lost = runs.where("run is null").select(
        _key(session, F.lit("untimed")).alias("id"), _key(session, F.lit("unknown")).alias("parent"), F.lit(0).cast("bigint").alias("weight"), *own
    )
    return nodes.unionByName(lost)


def conversation_ends(messages: DataFrame) -> DataFrame:
    """One row per session: n_usable, n_orphans, first_role (of the root) and last_role (of the leaf).

    Every session of the table has a row, also if nothing in it is usable (then roles are null).
    """
    lines = kept_table(usable_lines(messages))
    return _ends(lines, kept_table(run_nodes(_runs(lines))))


def _ends(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    found = nodes.join(resolve_parents(nodes.select("id", "parent", "weight")).select("id", "depth", "state"), "id")
    ok = F.col("state") == "ok"
    place = lambda c: F.when(ok, F.col("depth") * 2 + (F.col(c) == "assistant").cast("int"))
    role = lambda c: F.when(c % 2 == 1, "assistant").when(c % 2 == 0, "user")
    ends = found.groupBy("session_id").agg(
        F.min(place("first_role")).alias("first"), F.max(place("last_role")).alias("last"),
        F.sum("n").alias("n_usable"), F.sum(F.when(ok, 0).otherwise(F.col("n"))).alias("n_orphans"),
    )
    return lines.select("session_id").distinct().join(ends, "session_id", "left").select(
        "session_id", F.coalesce("n_usable", F.lit(0)).alias("n_usable"), F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
        role(F.col("first")).alias("first_role"), role(F.col("last")).alias("last_role"),
    )


def conversation_fault(ends: DataFrame) -> DataFrame:
    """``ends`` with ``fault``: empty, broken, no_question, no_reply, or null for a sound conversation."""
    return ends.withColumn(
        "fault",
        F.when(F.col("n_usable") == 0, "empty")
        .when(F.col("n_orphans") > 0, "broken")
        .when(F.col("first_role") != "user", "no_question")
        .when(F.col("last_role") != "assistant", "no_reply"),
    )


def conversation_turns(messages: DataFrame) -> DataFrame:
    """The sound conversations, one row per turn: (session_id, position, line_num, role, us).

    ``position`` counts from 0 in order of instants, ties by line_num. A conversation stays in rows:
    one long-running session is never gathered into one value. Conversations with a fault are dropped.
    """
    lines = kept_table(usable_lines(messages))
    nodes = kept_table(run_nodes(_runs(lines)))
    sound = kept_table(conversation_fault(_ends(lines, nodes)).where("fault is null").select("session_id"))
    pointers = kept_table(nodes.join(sound, "session_id", "left_semi").select("id", "parent", "weight"))
    # a conversation has one leaf, so each run stands in one path
    paths = root_to_leaf_paths(pointers).select("id", "depth").join(nodes.select("id", "session_id", "run"), "id")
    inside = Window.partitionBy("session_id", "run").orderBy("us", "line_num")
    return (
        lines.where("usable and us is not null")
        .withColumn("run", F.floor(F.col("us") / RUN_US))
        .withColumn("at", F.row_number().over(inside) - 1)
        .join(paths.select("session_id", "run", "depth"), ["session_id", "run"])
        .select("session_id", (F.col("depth") + F.col("at")).alias("position"), "line_num", "role", "us")
    )
