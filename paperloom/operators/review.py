"""The review process as DataFrame operators: scores, progress, loads, follow-up, visibility and rubrics.

Tables: assignments (report_id, referee_id, state, total, deadline), reports (report_id, competition_id, state, ...),
messages (report_id, seq, role, text). `state` of an assignment is completed, draft or null (not begun).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.numbers import clamp, days_left, is_open, percent, round_up_half
from paperloom.functions.text import excerpt


def _done(state: str = "state") -> Column:
    return F.coalesce(F.col(state) == "completed", F.lit(False))


def score_columns() -> list[Column]:
    """final (mean of completed totals, one decimal; null without any), spread (max - min), n_scores of a group of assignments."""
    total = F.when(_done(), F.col("total"))
    return [round_up_half(F.avg(total)).alias("final"), round_up_half(F.max(total) - F.min(total)).alias("spread"), F.count(total).alias("n_scores")]


def final_scores(assignments: DataFrame) -> DataFrame:
    """Per report: final, spread, n_scores."""
    return assignments.groupBy("report_id").agg(*score_columns())


def pass_marks(scores: DataFrame, mark: float, n_assigned: str = "n_assigned") -> DataFrame:
    """verdict (none, pending, passed, failed) and shortfall, on the shown score; nothing before all have finished."""
    ready = (F.col("n_scores") > 0) & (F.col("n_scores") == F.col(n_assigned))
    verdict = F.when(F.lit(mark).isNull(), "none").when(~ready, "pending").when(F.col("final") >= mark, "passed").otherwise("failed")
    return scores.withColumn("verdict", verdict).withColumn("shortfall", F.when(verdict == "failed", round_up_half(F.lit(mark) - F.col("final"))))


def referee_state(assignments: DataFrame) -> DataFrame:
    """Per report: n_assigned, n_completed, n_draft, all_done."""
    return assignments.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n_assigned"), F.count_if(_done()).alias("n_completed"),
        F.count_if(F.coalesce(F.col("state") == "draft", F.lit(False))).alias("n_draft"), F.bool_and(_done()).alias("all_done"),
    )


def flow_summary(reports: DataFrame, assignments: DataFrame, today: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Progress of reports and evaluations. A completed report without assignments counts as completed only."""
    late = ~_done() & F.coalesce(days_left(F.col("deadline"), today) < 0, F.lit(False))
    per = assignments.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_done()).alias("done"), F.count_if(late).alias("late")
    )
    r = reports.join(per, "report_id", "left").fillna(0, ["n", "done", "late"])
    finished = F.col("state") == "completed"
    measures = [
        F.count(F.lit(1)).alias("reports"),
        F.count_if(finished).alias("completed"),
        F.count_if(~finished & (F.col("n") > 0)).alias("assigned"),
        F.count_if(~finished & (F.col("n") == 0)).alias("unassigned"),
        F.count_if((F.col("n") > 0) & (F.col("done") == F.col("n"))).alias("all_evaluated"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("done"), F.lit(0)).alias("evaluated"),
        F.count_if(F.col("late") > 0).alias("late_reports"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late_evaluations"),
    ]
    return (r.groupBy(*by) if by else r).agg(*measures).withColumn("percent", percent(F.col("evaluated"), F.col("expected")))


def referee_load(referees: DataFrame, assignments: DataFrame) -> DataFrame:
    """Every referee, those without work too: assigned, completed, draft."""
    per = assignments.groupBy("referee_id").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(_done()).alias("completed"),
        F.count_if(F.coalesce(F.col("state") == "draft", F.lit(False))).alias("draft"),
    )
    return referees.join(per, "referee_id", "left").fillna(0, ["assigned", "completed", "draft"])


def dashboard(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: counts by state, mean absolute deviation of final and model score, agreement, cost."""
    r = reports.join(scores.select("report_id", "final"), "report_id", "left")
    gap = F.abs(F.col("final") - F.col("model_score"))
    agg = r.agg(
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("completed", "waiting", "uploaded")],
        F.count(gap).alias("n_compared"), round_up_half(F.avg(gap)).alias("mean_deviation"), F.count_if(gap <= 5).alias("n_close"),
        round_up_half(F.sum("cost"), 3).alias("cost"), round_up_half(F.sum("cost") / F.nullif(F.count("model_score"), F.lit(0)), 3).alias("cost_per_report"),
        F.count_if(F.col("cost") == 0).alias("n_cached"),
    )
    return agg.withColumn("agreement", percent(F.col("n_close"), F.col("n_compared"))).drop("n_close")


def counts_two_levels(reports: DataFrame) -> DataFrame:
    """Reports by competition and by category, from one pass."""
    sets = reports.groupingSets([[F.col("competition_id")], [F.col("category")]], "competition_id", "category")
    return sets.agg(F.count(F.lit(1)).alias("n"))


def missing_uploads(teams: DataFrame, reports: DataFrame) -> DataFrame:
    """Every team with its number of reports; those without any are missing."""
    per = reports.groupBy("team_id").agg(F.count(F.lit(1)).alias("n_reports"), F.max("uploaded").alias("last_upload"))
    return teams.join(per, "team_id", "left").fillna(0, ["n_reports"]).withColumn("missing", F.col("n_reports") == 0)


def latest(rows: DataFrame, group: tuple[str, ...], at: str, ties: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """The latest row of each group; with `ties`, all rows of the latest time, else the first by `then`.

    Ties come from a pre-aggregated maximum joined back, so that a hot group is never sorted in one task.
    """
    top = rows.groupBy(*group).agg(F.max(at).alias("_top"))
    found = rows.join(top, list(group)).where(F.col(at) == F.col("_top")).drop("_top")
    if ties:
        return found
    w = Window.partitionBy(*group).orderBy(*then)
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def awaiting_reply(messages: DataFrame) -> DataFrame:
    """Per report: whether the last human message is a referee's, since which message of that trailing run, how many.

    The run begins after the last human message of anybody else: two pre-aggregated extremes instead of a window.
    """
    human = messages.where(~F.col("automatic"))
    last = human.groupBy("report_id").agg(F.max(F.when(F.col("role") != "referee", F.col("seq"))).alias("other"))
    run = human.join(last, "report_id").where((F.col("role") == "referee") & (F.col("seq") > F.coalesce("other", F.lit(-1))))
    since = run.groupBy("report_id").agg(F.min("seq").alias("since"), F.count(F.lit(1)).alias("run"))
    return last.select("report_id").join(since, "report_id", "left").select(
        "report_id", F.col("since").isNotNull().alias("awaiting"), "since", F.coalesce("run", F.lit(0)).alias("run")
    )


def inbox(messages: DataFrame, length: int = 60) -> DataFrame:
    """Per conversation: last message (role, excerpt), number of messages, whether a reply is due."""
    last = messages.groupBy("report_id").agg(F.max_by(F.struct("role", "text"), "seq").alias("m"), F.count(F.lit(1)).alias("n_messages"), F.max("seq").alias("last_seq"))
    wait = awaiting_reply(messages).select("report_id", "awaiting")
    return last.join(wait, "report_id", "left").select(
        "report_id", F.col("m.role").alias("last_role"), excerpt(F.col("m.text"), length).alias("excerpt"), "n_messages", "last_seq",
        F.coalesce("awaiting", F.lit(False)).alias("awaiting"),
    )


#: Letters of aliases, in order of first appearance.
ALIASES = "ABCDEFGHJKLMNOPRSTUVYZ"


def referee_alias(assignments: DataFrame) -> DataFrame:
    """report_id, referee_id, alias: a letter by first appearance, with 2, 3 ... after each round of the alphabet."""
    w = Window.partitionBy("report_id").orderBy("assigned", "referee_id")
    k = (F.row_number().over(w) - 1).alias("k")
    a = assignments.select("report_id", "referee_id", k)
    n = len(ALIASES)
    turn = F.floor(F.col("k") / n)
    alias = F.concat(F.substring(F.lit(ALIASES), (F.col("k") % n + 1).cast("int"), F.lit(1)), F.when(turn > 0, (turn + 1).cast("string")).otherwise(""))
    return a.select("report_id", "referee_id", alias.alias("alias"))


def visible(messages: DataFrame, board_open: Column, me: Column) -> DataFrame:
    """Messages that a referee may see: to all, their own channel, and the board's once it is open."""
    return messages.where((F.col("channel") == "all") | ((F.col("channel") == "own") & (F.col("referee_id") == me)) | ((F.col("channel") == "board") & board_open))


def board_open(assignments: DataFrame) -> DataFrame:
    """Per report: two referees or more, and all have finished."""
    return assignments.groupBy("report_id").agg((F.bool_and(_done()) & (F.count(F.lit(1)) >= 2)).alias("board_open"))


def clamp_scores(scores: DataFrame, rubric: DataFrame) -> DataFrame:
    """Submitted scores of known criteria within [0, points], notes cut at 2000 characters; unknown criteria go."""
    return scores.join(rubric, "criterion").withColumn("score", clamp(F.col("score"), 0.0, F.col("points"))).withColumn("note", F.substring("note", 1, 2000))


def criterion_average(scores: DataFrame) -> DataFrame:
    """Mean over those who scored the criterion, how many they are, and the notes that are not blank, in order.

    A report has few scores, so these meet first and what is grouped by report needs no other shuffle.
    """
    note = F.when(F.trim("note") != "", F.struct("referee_id", "note"))
    return scores.repartition("report_id").groupBy("report_id", "criterion").agg(
        round_up_half(F.avg("score")).alias("mean"), F.count("score").alias("n_scorers"),
        F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]).alias("notes"),
    )


def first_wins(rows: DataFrame, group: tuple[str, ...], text: str, order: str) -> DataFrame:
    """Of texts that are equal but for case and blanks, the first of each group."""
    norm = F.lower(F.translate(F.trim(F.regexp_replace(text, r"\s+", " ")), "İI", "iı"))
    keep = rows.withColumn("_norm", norm).where(F.col("_norm") != "").groupBy(*group, "_norm")
    return keep.agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def rescale(rubric: DataFrame, target: float) -> DataFrame:
    """Points of each rubric scaled to `target`, one decimal; what rounding leaves goes to the largest (first) criterion."""
    total = F.sum("points").over(Window.partitionBy("rubric_id"))
    r = rubric.withColumn("scaled", round_up_half(F.col("points") * target / total))
    left = F.lit(target) - F.sum("scaled").over(Window.partitionBy("rubric_id"))
    first = F.row_number().over(Window.partitionBy("rubric_id").orderBy(F.col("scaled").desc(), "ord")) == 1
    return r.withColumn("scaled", round_up_half(F.when(first, F.col("scaled") + left).otherwise(F.col("scaled"))))


def draft_rubric(criteria: DataFrame) -> DataFrame:
    """Equal whole points that add up to 100: the remainder goes to the first criterion."""
    n = F.count(F.lit(1)).over(Window.partitionBy("rubric_id"))
    first = F.row_number().over(Window.partitionBy("rubric_id").orderBy("ord")) == 1
    base = F.floor(F.lit(100) / n)
    return criteria.withColumn("draft_points", F.when(first, base + 100 - base * n).otherwise(base).cast("long"))


def assign(targets: DataFrame, referees: DataFrame, existing: DataFrame, k: int) -> DataFrame:
    """Balanced assignment per competition: each target, in order, gets `k` more referees (1 at least, all at most), the
    least loaded (ties: input order) of those it does not have yet; loads count as they grow. A target that has them all
    is skipped and comes out with a null referee.

    targets: report_id, competition_id, ord; referees: competition_id, referee_id, ord, load; existing: report_id,
    referee_id. Each choice depends on all before it, so a competition is one group, but competitions run in parallel and
    a group holds numbers only, in the order in which Spark has sorted them.
    """
    have = existing.groupBy("report_id").agg(F.collect_set("referee_id").alias("have"))
    t = targets.join(have, "report_id", "left").select("competition_id", "report_id", "ord", "have")

    def run(t, r):
        import heapq

        import pandas as pd

        heap = [(int(n), int(o), int(i)) for n, o, i in zip(r["load"], r["ord"], r["referee_id"], strict=True)]
        heapq.heapify(heap)
        each, out = min(max(k, 1), max(1, len(heap))), []
        for report, have in t.sort_values("ord")[["report_id", "have"]].itertuples(index=False):
            taken = set() if have is None or not hasattr(have, "__len__") else set(have)
            passed, chosen = [], 0
            while heap and chosen < each:
                load, order, referee = heapq.heappop(heap)
                if referee not in taken:
                    out.append((report, referee))
                    load, chosen = load + 1, chosen + 1
                passed.append((load, order, referee))
            for x in passed:
                heapq.heappush(heap, x)
            if not chosen:
                out.append((report, None))
        return pd.DataFrame({"report_id": [x[0] for x in out], "referee_id": pd.array([x[1] for x in out], "Int64")})

    return t.groupBy("competition_id").cogroup(referees.groupBy("competition_id")).applyInPandas(run, "report_id long, referee_id long")


def stage_state(calendar: DataFrame, today: Column) -> DataFrame:
    """Per stage, from its first deadline and result rows: future, evaluation, done or unknown, and the days left."""
    kind = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("day")), F.when(F.col("kind") == k, F.col("seq")))
    c = calendar.groupBy("stage").agg(kind("deadline").alias("deadline"), kind("result").alias("result"))
    state = (
        F.when(F.coalesce("deadline", "result").isNull(), "unknown")
        .when(is_open(F.col("deadline"), today) & F.col("deadline").isNotNull(), "future")
        .when(F.col("result").isNull() | (days_left(F.col("result"), today) >= 0), "evaluation")
        .otherwise("done")
    )
    return c.withColumn("state", state).withColumn("days", days_left(F.col("deadline"), today))
