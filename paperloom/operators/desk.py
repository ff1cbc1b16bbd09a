"""The coordination desk: filters, listings, guards, gates and boards over reports, applications, referees and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.numbers import days_left, round_up_half

#: Levels of participants, in the order in which they are shown.
LEVELS = ["İlkokul", "Ortaokul", "Yıldızlar", "Lise", "Üniversite", "Mezun"]
#: Similarity from which a heading is the template's, and share of found headings under which no template fits.
HEADING_SIMILARITY, TEMPLATE_SHARE = 0.72, 0.5


def filter_reports(reports: DataFrame, competitions: DataFrame, competition: int | None = None, category: str | None = None, season: int | None = None) -> DataFrame:
    """Reports that meet every given condition. The season is the competition's, never the day of the upload."""
    found = reports
    if competition is not None:
        found = found.where(F.col("competition_id") == competition)
    if category is not None:
        found = found.where(F.col("category") == category)
    if season is not None:
        found = found.join(competitions.where(F.col("season") == season).select("competition_id"), "competition_id", "left_semi")
    return found


def within(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list of any length."""
    return rows.join(ids.select(key), key, "left_semi")


def by_number(reports: DataFrame, asked: DataFrame) -> DataFrame:
    """All reports of each asked number, spelled in whatever way, with their place by upload and id.

    reports: report_id, number, uploaded; asked: asked_id, number.
    """
    r = reports.withColumn("_k", T.key(F.col("number"), normal=True)).drop("number")
    a = asked.withColumn("_k", T.key(F.col("number"), normal=True)).where(F.col("_k") != "").drop("number")
    place = F.row_number().over(Window.partitionBy("asked_id").orderBy("uploaded", "report_id"))
    return a.join(r, "_k").drop("_k").withColumn("place", place)


def first_tab(counts: DataFrame, tabs: list[str]) -> DataFrame:
    """`counts` plus tab: the first of `tabs` (columns of counts) that holds anything, else the last."""
    return counts.withColumn("tab", F.coalesce(*[F.when(F.col(t) > 0, F.lit(t)) for t in tabs], F.lit(tabs[-1])))


def application_stage(applications: DataFrame, reports: DataFrame, assignments: DataFrame, scores: DataFrame) -> DataFrame:
    """application_id, stage (applied, uploaded, evaluation, concluded), locked: an assignment exists.

    reports: application_id, report_id; scores: report_id, final. An application is concluded once it has a final score.
    """
    n = assignments.select("report_id").distinct().withColumn("locked", F.lit(True))
    a = applications.select("application_id").join(reports, "application_id", "left").join(n, "report_id", "left").join(scores.select("report_id", "final"), "report_id", "left")
    stage = F.when(F.col("report_id").isNull(), "applied").when(F.col("final").isNotNull(), "concluded").when(F.col("locked"), "evaluation").otherwise("uploaded")
    return a.select("application_id", stage.alias("stage"), F.coalesce("locked", F.lit(False)).alias("locked"))


def readiness(catalogue: DataFrame, installed: DataFrame, categories: DataFrame) -> DataFrame:
    """Per competition of the catalogue (competition_id, has_template): categories, approved ones, those with a
    specification and with its summary, and status: ready, needs_review, installable or no_template.

    installed: competition_id; categories: competition_id, approved, spec, summary.
    """
    n = categories.groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("categories"), F.count_if("approved").alias("approved"), F.count_if("spec").alias("with_spec"), F.count_if("summary").alias("with_summary")
    )
    c = catalogue.join(installed.select("competition_id").distinct().withColumn("_in", F.lit(True)), "competition_id", "left").join(n, "competition_id", "left")
    c = c.fillna(0, ["categories", "approved", "with_spec", "with_summary"])
    ready = (F.col("categories") > 0) & (F.col("approved") == F.col("categories"))
    status = F.when(F.col("_in"), F.when(ready, "ready").otherwise("needs_review")).when(F.col("has_template"), "installable").otherwise("no_template")
    return c.select("competition_id", "categories", "approved", "with_spec", "with_summary", status.alias("status"))


def levels(own: DataFrame, documents: DataFrame, categories: DataFrame) -> DataFrame:
    """competition_id, levels: distinct levels from three sources, in their order.

    own, documents: competition_id, level; categories: competition_id, name, which may say a level.
    """
    named = categories.select("competition_id", F.explode(F.array(*[F.when(F.contains(F.col("name"), F.lit(x)), F.lit(x)) for x in LEVELS])).alias("level"))
    every = own.unionByName(documents).unionByName(named).where(F.col("level").isin(LEVELS)).distinct()
    place = F.array_position(F.lit(LEVELS), F.col("level"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("level").alias("l")))), lambda x: x["l"])
    return every.groupBy("competition_id").agg(ordered.alias("levels"))


def upper_tr(text: Column) -> Column:
    """Turkish upper case: dotted and dotless i keep apart."""
    return F.upper(F.translate(text, "iı", "İI"))


def already_applied(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """`incoming` (number, code, ...) plus duplicate: an active application has the same number and code."""
    keys = lambda df: df.withColumn("_n", upper_tr(F.trim("number"))).withColumn("_c", upper_tr(F.trim("code")))
    known = keys(existing.where("active")).select("_n", "_c").distinct().withColumn("duplicate", F.lit(True))
    return keys(incoming).join(known, ["_n", "_c"], "left").fillna(False, ["duplicate"]).drop("_n", "_c")


def evaluation_gate(submissions: DataFrame, assignments: DataFrame) -> DataFrame:
    """`submissions` (report_id, referee_id, scores) plus verdict (not_assigned, completed, accepted) and total, the sum of
    the scores; an evaluation must be assigned and not yet completed."""
    a = assignments.select("report_id", "referee_id", F.lit(True).alias("_a"), F.coalesce(F.col("state") == "completed", F.lit(False)).alias("_done"))
    verdict = F.when(F.col("_a").isNull(), "not_assigned").when(F.col("_done"), "completed").otherwise("accepted")
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return submissions.join(a, ["report_id", "referee_id"], "left").withColumn("verdict", verdict).withColumn("total", total).drop("_a", "_done")


def delete_guard(referees: DataFrame, assignments: DataFrame) -> DataFrame:
    """referee_id, n_assigned, action: deactivate where an evaluation was begun, else delete."""
    n = assignments.groupBy("referee_id").agg(F.count(F.lit(1)).alias("n_assigned"), F.bool_or(F.col("state").isNotNull()).alias("_begun"))
    r = referees.select("referee_id").join(n, "referee_id", "left").fillna(0, ["n_assigned"])
    return r.select("referee_id", "n_assigned", F.when(F.coalesce("_begun", F.lit(False)), "deactivate").otherwise("delete").alias("action"))


def bulk_insert(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """`incoming` plus outcome: inserted, exists (the key is known) or repeated (an earlier row of the batch has it)."""
    first = incoming.groupBy(key).agg(F.min(order).alias("_first"))
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    out = incoming.join(first, key).join(known, key, "left")
    outcome = F.when(F.col("_known"), "exists").when(F.col(order) > F.col("_first"), "repeated").otherwise("inserted")
    return out.withColumn("outcome", outcome).drop("_first", "_known")


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[Column], child: Column, child_order: Column) -> DataFrame:
    """`parents` in `order` (column place, from 1) with their children as an array, each in its own order."""
    c = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(child_order.alias("o"), child.alias("c")))), lambda x: x["c"]).alias("children"))
    return parents.join(c, key, "left").withColumn("place", F.row_number().over(Window.orderBy(*order)))


def listed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """`rows` with their place in their group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def unread(messages: DataFrame) -> DataFrame:
    """Per report: the applicant's messages since anybody else last wrote, and the latest of all of the applicant's."""
    other = messages.groupBy("report_id").agg(F.max(F.when(F.col("role") != "referee", F.col("seq"))).alias("_other"))
    mine = messages.where(F.col("role") == "referee").join(other, "report_id")
    return mine.groupBy("report_id").agg(F.count_if(F.col("seq") > F.coalesce("_other", F.lit(-1))).alias("unread"), F.max_by("text", "seq").alias("question"))


def pair_records(rows: DataFrame, x: str, y: str, at: str) -> DataFrame:
    """Records of unordered pairs: a <= b, how many rows name the pair, and the latest of them."""
    return rows.groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("latest"))


def taken_keys(asked: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """`asked` plus taken: the key occurs in any of the tables (one column each)."""
    known = tables[0].toDF(key)
    for t in tables[1:]:
        known = known.unionByName(t.toDF(key))
    return asked.join(known.distinct().withColumn("taken", F.lit(True)), key, "left").fillna(False, ["taken"])


def shared_targets(targets: DataFrame, source: Column, key: str) -> DataFrame:
    """One target per source: that of the smallest key, and how many others share it."""
    return targets.groupBy(source.alias("source")).agg(F.min(key).alias(key), (F.count(F.lit(1)) - 1).alias("sharers"))


def deadline_board(groups: DataFrame, today: Column, k: int = 6) -> DataFrame:
    """The `k` groups (group_id, applications, missing, deadline) most at risk: open ones before closed, then the nearest
    deadline, the most missing uploads and the id."""
    g = groups.withColumn("days", days_left(F.col("deadline"), today))
    closed = F.coalesce(F.col("days") < 0, F.lit(True))
    return g.orderBy(closed, F.col("days").asc_nulls_last(), F.col("missing").desc(), "group_id").limit(k)


def balance(assignments: DataFrame) -> DataFrame:
    """One row: fewest and most assignments of a referee, and their difference."""
    n = assignments.groupBy("referee_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("fewest"), F.max("n").alias("most"), (F.max("n") - F.min("n")).alias("gap"))


def mean_published(scores: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: mean final score of completed reports, one decimal, and how many have one."""
    s = scores.join(reports.where("state = 'completed'").select("report_id"), "report_id", "left_semi")
    return s.agg(round_up_half(F.avg("final")).alias("mean"), F.count("final").alias("n"))


def usage(calls: DataFrame, by: str) -> DataFrame:
    """Tokens, and whether all calls came from the cache."""
    return calls.groupBy(by).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"), F.bool_and("cached").alias("all_cached"))


def referees_awaiting(messages: DataFrame) -> DataFrame:
    """report_id, referee_id of referees whose addressed message is the last one of theirs; automatic and unaddressed
    messages don't count."""
    m = messages.where(~F.col("automatic") & F.col("referee_id").isNotNull())
    last = m.groupBy("report_id", "referee_id").agg(F.max_by("role", "seq").alias("_role"))
    return last.where(F.col("_role") == "referee").drop("_role")


def latest_open(messages: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports of `reports` whose last message that is not automatic is a referee's: report_id, seq."""
    m = messages.where(~F.col("automatic")).join(reports.select("report_id"), "report_id", "left_semi")
    last = m.groupBy("report_id").agg(F.max_by(F.struct("role", "seq"), "seq").alias("m"))
    return last.where(F.col("m.role") == "referee").select("report_id", F.col("m.seq").alias("seq"))


def effective_words(sections: DataFrame) -> DataFrame:
    """`sections` (doc_id, number, words) plus effective: own words and those of all sections below.

    Each section counts for every number that its own begins with, so the join is by number, not by prefix.
    """
    parts = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    sums = sections.where(F.col("number").isNotNull()).select("doc_id", F.explode(above).alias("number"), "words", (F.size(parts) > 0).alias("_"), F.col("number").alias("_own"))
    below = sums.where(F.col("_own") != F.col("number")).groupBy("doc_id", "number").agg(F.sum("words").alias("_below"))
    return sections.join(below, ["doc_id", "number"], "left").withColumn("effective", F.col("words") + F.coalesce("_below", F.lit(0))).drop("_below")


def best_template(sections: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, template, share: the template of which most required headings are found; the first on a tie.

    sections: doc_id, key; headings: template, rank, key (of required headings). Templates are a small dimension, which
    meets the distinct titles; documents only meet the titles that match.
    """
    titles = sections.select("key").distinct()
    size = headings.groupBy("template", "rank").agg(F.count(F.lit(1)).alias("size"))
    close = titles.alias("t").join(headings.alias("h"), T.similarity(F.col("t.key"), F.col("h.key")) >= HEADING_SIMILARITY).select(F.col("t.key").alias("key"), "template", F.col("h.key").alias("heading"))
    found = sections.select("doc_id", "key").distinct().join(close, "key").groupBy("doc_id", "template").agg(F.countDistinct("heading").alias("found"))
    scored = found.join(size, "template").withColumn("share", F.col("found") / F.col("size"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("template", "share"), F.struct("share", -F.col("rank"))).alias("b"))
    return sections.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.col("b.template").alias("template"), F.coalesce("b.share", F.lit(0.0)).alias("share"))


def template_findings(docs: DataFrame, best: DataFrame, current: str, min_pages: int | None, max_pages: int | None) -> DataFrame:
    """Findings (doc_id, code, severity) of the template check.

    docs: doc_id, pages, scanned, n_placeholders. An older template must fit better than by half to be named; under half,
    none fits.
    """
    d = docs.join(best, "doc_id", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    old = (F.col("template") != current) & (F.col("share") > TEMPLATE_SHARE)
    rules = [
        (F.col("scanned"), "SCANNED", "error"), (old, "TEMPLATE_OLD", "warning"), (~F.coalesce(old, F.lit(False)) & (F.col("share") < TEMPLATE_SHARE), "TEMPLATE_UNKNOWN", "error"),
        (F.col("pages") > F.lit(max_pages), "PAGES_OVER", "warning"), (F.col("pages") < F.lit(min_pages), "PAGES_UNDER", "warning"), (F.col("n_placeholders") > 0, "PLACEHOLDERS_LEFT", "warning"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"))) for c, k, s in rules]))
    return d.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def merged_rules(templates: DataFrame, specs: DataFrame) -> DataFrame:
    """category_id, min_pages, max_pages, conflict: what the specification says, else the template; conflict: both say a
    largest number of pages, and not the same."""
    s = specs.select("category_id", F.col("min_pages").alias("_min"), F.col("max_pages").alias("_max"))
    t = templates.join(s, "category_id", "left")
    conflict = F.coalesce(F.col("_max") != F.col("max_pages"), F.lit(False))
    return t.select("category_id", F.coalesce("_min", "min_pages").alias("min_pages"), F.coalesce("_max", "max_pages").alias("max_pages"), conflict.alias("conflict"))


def seen_as(aliases: DataFrame, me: DataFrame) -> DataFrame:
    """`aliases` (report_id, referee_id, alias) plus shown, the name that the referee `me` of a report (report_id, me) reads:
    "you (A)" for themselves, the alias for others; a referee without an alias stays "referee"."""
    m = aliases.join(me, "report_id", "left")
    return m.withColumn("shown", F.when(F.col("referee_id") == F.col("me"), F.concat(F.lit("you ("), "alias", F.lit(")"))).otherwise(F.coalesce("alias", F.lit("referee")))).drop("me")


def loosely_equal(x: Column, y: Column) -> Column:
    """Whether two comparison keys may name the same: one in the other, or .6 of the smaller's words of three letters or
    more shared; a missing side never differs."""
    words = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda w: F.length(w) > 2))
    small = F.least(F.size(words(x)), F.size(words(y)))
    shared = F.size(F.array_intersect(words(x), words(y)))
    some = F.when(small > 0, shared / F.nullif(small, F.lit(0)) >= 0.6).otherwise(False)
    return F.coalesce((x == "") | (y == "") | F.contains(x, y) | F.contains(y, x) | some, F.lit(True))


def expiry(sessions: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """`sessions` plus expires and alive."""
    ends = F.col(at) + F.make_dt_interval(F.lit(days))
    return sessions.withColumn("expires", ends).withColumn("alive", ends > now)
