"""Analytics over append-only tables of runs, findings, verdicts, calls and premises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import reach, reached_from
from .relops import pick


def full_runs(runs: DataFrame) -> DataFrame:
    """Only unscoped runs count as a state of the project."""
    return runs.where(F.col("scope").isNull())


def latest_run(runs: DataFrame) -> DataFrame:
    return full_runs(runs).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)


def baseline_runs(runs: DataFrame) -> DataFrame:
    """run_id, baseline: the previous full run of the project."""
    window = Window.partitionBy("project").orderBy("started_at", "run_id")
    return full_runs(runs).select("project", "run_id", F.lag("run_id").over(window).alias("baseline"))


def neighbour_gaps(counts: DataFrame) -> DataFrame:
    """Runs with at most half the findings of both neighbours: (project, run_id, started_at, n)."""
    window = Window.partitionBy("project").orderBy("started_at", "run_id")
    met = counts.withColumn("prev_n", F.lag("n").over(window)).withColumn("next_n", F.lead("n").over(window))
    return met.where((2 * F.col("n") <= F.col("prev_n")) & (2 * F.col("n") <= F.col("next_n")))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """identity, was_id, now_id, state of findings (identity, finding_id): same, reworded, gone, new.

    Findings of equal id are the same; the others of one identity are paired one to one in the order of their ids.
    """
    a = before.select("identity", F.col("finding_id").alias("was_id"))
    b = after.select("identity", F.col("finding_id").alias("now_id"))
    same = a.join(b, (a["identity"] == b["identity"]) & (a["was_id"] == b["now_id"])).select(a["identity"], "was_id", "now_id", F.lit("same").alias("state"))
    rank = lambda c: F.row_number().over(Window.partitionBy("identity").orderBy(c))
    rest_a = a.join(same.select("identity", "was_id"), ["identity", "was_id"], "left_anti").withColumn("k", rank("was_id"))
    rest_b = b.join(same.select("identity", "now_id"), ["identity", "now_id"], "left_anti").withColumn("k", rank("now_id"))
    state = F.when(F.col("now_id").isNull(), "gone").when(F.col("was_id").isNull(), "new").otherwise("reworded")
    return same.union(rest_a.join(rest_b, ["identity", "k"], "full").select("identity", "was_id", "now_id", state.alias("state")))


def finding_identity(check: Column, subject: Column, evidence: Column, measured: list[str]) -> Column:
    """Twelve hex digits over check, subject and evidence (map) without its measured keys."""
    stable = F.map_filter(evidence, lambda k, _: ~k.isin(*measured)) if measured else evidence
    ordered = F.array_sort(F.map_entries(stable))
    return F.substring(F.sha1(F.to_json(F.struct(check.alias("c"), subject.alias("s"), ordered.alias("e")))), 1, 12)


def carried_ids(now: DataFrame, history: DataFrame) -> DataFrame:
    """finding_id, earlier: all earlier ids of the same identity."""
    met = now.select("finding_id", "identity").join(history.select("identity", F.col("finding_id").alias("old")).distinct(), "identity").where("old <> finding_id")
    return met.groupBy("finding_id").agg(F.sort_array(F.collect_set("old")).alias("earlier"))


def first_seen(findings: DataFrame) -> DataFrame:
    """identity, first_at, first_run, runs."""
    return findings.groupBy("identity").agg(F.min("started_at").alias("first_at"), F.min_by("run_id", F.struct("started_at", "run_id")).alias("first_run"), F.countDistinct("run_id").alias("runs"))


def prune(table: DataFrame, runs: DataFrame, keep: int) -> DataFrame:
    """The rows of the last ``keep`` runs of each project."""
    kept = pick(runs, ["project"], ["started_at desc", "run_id desc"], keep)
    return table.join(kept.select("run_id"), "run_id", "left_semi")


def effectiveness(verdicts: DataFrame) -> DataFrame:
    """family, prompt_version, model_version, n, agree, accept, disagree, unclear, agreement.

    Agreement = (agree + accept) / (agree + accept + disagree); NULL where nothing was decided.
    """
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    told = verdicts.groupBy("family", "prompt_version", "model_version").agg(F.count("*").alias("n"), *[count(v).alias(v) for v in ("agree", "accept", "disagree", "unclear")])
    decided = F.col("agree") + F.col("accept") + F.col("disagree")
    return told.withColumn("agreement", F.when(decided > 0, (F.col("agree") + F.col("accept")) / decided))


def accuracy_by_family(verdicts: DataFrame, shipping: DataFrame) -> DataFrame:
    """Effectiveness at the shipping version of each family (family, prompt_version); a family without verdicts has n = 0."""
    told = effectiveness(verdicts).groupBy("family", "prompt_version").agg(*[F.sum(c).alias(c) for c in ("n", "agree", "accept", "disagree")])
    met = shipping.join(told, ["family", "prompt_version"], "left").na.fill(0, ["n", "agree", "accept", "disagree"])
    decided = F.col("agree") + F.col("accept") + F.col("disagree")
    return met.withColumn("agreement", F.when(decided > 0, (F.col("agree") + F.col("accept")) / decided))


def open_disagreements(verdicts: DataFrame) -> DataFrame:
    """Disagreements with a note and no later agreement on the same subject and question at another version."""
    later = verdicts.where("verdict = 'agree'").select("subject", "question", F.col("prompt_version").alias("v2"), F.col("decided_at").alias("at2"))
    open_ = verdicts.where("verdict = 'disagree' and note is not null and note <> ''")
    condition = (open_["subject"] == later["subject"]) & (open_["question"] == later["question"]) & (later["v2"] != open_["prompt_version"]) & (later["at2"] > open_["decided_at"])
    return open_.join(later, condition, "left_anti")


def latest_rulings(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    return pick(verdicts, keys, ["decided_at desc", "verdict"])


def wilson(agree: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval, clipped to 0..1, four decimals; NULL for n = 0."""
    p = agree / n
    middle, margin, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low, high = (middle - margin) / scale, (middle + margin) / scale
    known = lambda c: F.when(n > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4))
    return known(low), known(high)


def confidence_band(p: Column) -> Column:
    return F.when(p.isNull(), "no probability").when(p < 0.3, "<.3").when(p < 0.5, ".3-.5").when(p < 0.7, ".5-.7").otherwise(".7+")


def calibration(answers: DataFrame) -> DataFrame:
    """family, band, n, agree, low, high out of (family, p, agreed)."""
    told = answers.groupBy("family", confidence_band(F.col("p")).alias("band")).agg(F.count("*").alias("n"), F.count(F.when(F.col("agreed"), 1)).alias("agree"))
    low, high = wilson(F.col("agree"), F.col("n"))
    return told.withColumn("low", low).withColumn("high", high)


def bands_separated(calibrated: DataFrame) -> DataFrame:
    """family, separated: do any two bands have disjoint intervals?"""
    a, b = calibrated.alias("a"), calibrated.alias("b")
    apart = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.high") < F.col("b.low"))).select(F.col("a.family").alias("family")).distinct().withColumn("separated", F.lit(True))
    return calibrated.select("family").distinct().join(apart, "family", "left").na.fill(False, ["separated"])


def spend_ledger(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and dollars: tokens are summed as integers by rate, then priced; calls without usage count apart."""
    once = calls.dropDuplicates(["call_id"])
    by_rate = once.groupBy(*by, "usd_per_token").agg(F.count("*").alias("calls"), F.count(F.when(F.col("tokens").isNull(), 1)).alias("unmetered"), F.sum("tokens").alias("tokens"))
    priced = (F.col("tokens") * F.col("usd_per_token")).cast("decimal(38,12)")
    return by_rate.groupBy(*by).agg(F.sum("calls").alias("calls"), F.sum("unmetered").alias("unmetered"), F.sum("tokens").alias("tokens"), F.sum(priced).cast("double").alias("usd"))


def warehouse_ledger(calls: DataFrame, by: list[str]) -> DataFrame:
    """Statements, failures, wall and engine milliseconds (never added), and money without failed statements in exact decimals."""
    fine = ~F.coalesce("failed", F.lit(False))
    return calls.groupBy(*by).agg(
        F.count("*").alias("statements"), F.count(F.when(~fine, 1)).alias("failures"), F.sum("wall_ms").alias("wall_ms"), F.sum("exec_ms").alias("exec_ms"),
        F.sum(F.when(fine, F.col("usd").cast("decimal(38,12)"))).cast("double").alias("usd"),
    )


def spend_days(runs: DataFrame, calls: DataFrame, statements: DataFrame) -> DataFrame:
    """day, runs, calls, statements, reason: days on which anything ran; a day without a call says why."""
    daily = lambda df, name: df.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias(name))
    met = daily(runs, "runs").join(daily(calls, "calls"), "day", "full").join(daily(statements, "statements"), "day", "full").na.fill(0)
    reason = F.when((F.col("calls") == 0) & (F.col("runs") > 0), "ran without asking").when(F.col("calls") == 0, "counted only")
    return met.withColumn("reason", reason)


def trend(findings: DataFrame, kinds: list[str]) -> DataFrame:
    """run_id and one count for each kind."""
    return findings.groupBy("run_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds], F.count("*").alias("n"))


def churn(commits: DataFrame, top: int) -> DataFrame:
    """Models by number of commits: (sha, models array)."""
    return commits.select("sha", F.explode("models").alias("model")).groupBy("model").agg(F.countDistinct("sha").alias("commits")).orderBy(F.col("commits").desc(), "model").limit(top)


def stale_answers(answers: DataFrame, current: DataFrame) -> DataFrame:
    """subject, state of the latest answer: uncheckable, moved or current, by checksum."""
    last = pick(answers, ["subject", "question"], ["decided_at desc", "checksum"])
    met = last.join(current.select("subject", F.col("checksum").alias("now")), "subject", "left")
    state = F.when(F.col("checksum").isNull() | F.col("now").isNull(), "uncheckable").when(F.col("checksum") != F.col("now"), "moved").otherwise("current")
    return met.select("subject", "question", state.alias("state"))


def premise_changes(premises: DataFrame) -> DataFrame:
    """Premises (premise_id, run_at, status) whose status moved since the previous run; ``since`` starts each streak."""
    window = Window.partitionBy("premise_id").orderBy("run_at")
    moved = premises.withColumn("was", F.lag("status").over(window))
    return moved.where(F.col("was").isNotNull() & (F.col("was") != F.col("status"))).select("premise_id", F.col("run_at").alias("since"), "was", F.col("status").alias("now"))


def fixed_and_returned(agreed: DataFrame, seen: DataFrame, runs: DataFrame) -> DataFrame:
    """identity, state of agreed findings: fixed (absent from the last run) or returned (absent in a run, then seen again) or open."""
    ordered = runs.select("run_no")
    grid = agreed.select("identity", F.col("agreed_in").alias("from_no")).join(ordered, F.col("run_no") > F.col("from_no"))
    there = seen.select("identity", "run_no").distinct().withColumn("there", F.lit(True))
    met = grid.join(there, ["identity", "run_no"], "left").na.fill(False, ["there"])
    told = met.groupBy("identity").agg(F.min(F.when(~F.col("there"), F.col("run_no"))).alias("gone_no"), F.max(F.when(F.col("there"), F.col("run_no"))).alias("last_there"), F.max("run_no").alias("last_no"))
    state = F.when(F.col("gone_no").isNull(), "open").when(F.col("last_there") > F.col("gone_no"), "returned").when(F.coalesce("last_there", F.lit(-1)) < F.col("last_no"), "fixed").otherwise("open")
    return told.select("identity", state.alias("state"))


def group_findings(findings: DataFrame) -> DataFrame:
    """check_name, shape, subjects: shapes of evidence held by two subjects or more, largest first."""
    return findings.groupBy("check_name", "shape").agg(F.countDistinct("subject").alias("subjects")).where("subjects >= 2").orderBy(F.col("subjects").desc(), "check_name", "shape")


def check_rollup(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check_name").agg(F.count("*").alias("findings"), F.countDistinct("subject").alias("models"), F.avg("weight").alias("mean_weight"), F.max("marts").alias("worst_reach"))


def gate_verdict(parts: DataFrame) -> DataFrame:
    """verdict, failed, skipped out of (part, outcome): any failed part fails; skipped parts are counted and never pass."""
    count = lambda v: F.count(F.when(F.col("outcome") == v, 1))
    told = parts.agg(count("fail").alias("failed"), count("skipped").alias("skipped"), count("pass").alias("passed"))
    return told.withColumn("verdict", F.when(F.col("failed") > 0, "fail").when(F.col("passed") > 0, "pass").otherwise("skipped"))


def threshold(expression: str) -> Column:
    """A policy threshold over p, confidence, answer and score; anything else is refused."""
    import re

    for word in re.findall(r"'[^']*'|[A-Za-z_]\w*|[^\s\w]+|\d[\w.]*", expression):
        if not (word.lower() in {"p", "confidence", "answer", "score", "and", "or", "not", "true", "false"} or word[0] == "'" or re.fullmatch(r"\d+(\.\d+)?|[<>=!]+|[()]+", word)):
            raise ValueError(f"not allowed in a threshold: {word}")
    return F.expr(expression)


def action_policy(findings: DataFrame, rules: dict[str, str], verdicts: Column, agreement: Column, least_verdicts: int, least_agreement: float) -> DataFrame:
    """Column ``action``: the strongest of fail, queue, annotate whose threshold holds; ``fail`` without enough agreement becomes ``queue``."""
    chosen = F.lit(None).cast("string")
    for action in ("annotate", "queue", "fail"):
        if action in rules:
            chosen = F.when(threshold(rules[action]), action).otherwise(chosen)
    weak = (verdicts < least_verdicts) | (agreement.isNotNull() & (agreement < least_agreement))
    return findings.withColumn("__a", chosen).withColumn("action", F.when((F.col("__a") == "fail") & weak, "queue").otherwise(F.col("__a"))).drop("__a")


def repeated_reasons(rulings: DataFrame) -> DataFrame:
    """reason, subjects: the same normalised reason over two subjects or more."""
    norm = F.trim(F.regexp_replace(F.lower("reason"), "[^a-z0-9]+", " "))
    return rulings.groupBy(norm.alias("reason")).agg(F.countDistinct("subject").alias("subjects")).where("subjects >= 2")


def vocabulary(joins: DataFrame, known: DataFrame, least_hops: int = 3, least_models: int = 2) -> DataFrame:
    """Join columns (model, joined_on array) worth a word: enough hops and models, not known yet; by models, then hops."""
    told = joins.select("model", F.explode("joined_on").alias("term")).groupBy("term").agg(F.count("*").alias("hops"), F.countDistinct("model").alias("models"))
    return told.where((F.col("hops") >= least_hops) & (F.col("models") >= least_models)).join(known.select("term"), "term", "left_anti").orderBy(F.col("models").desc(), F.col("hops").desc(), "term")


def estimate_bytes(columns: DataFrame, widths: DataFrame) -> DataFrame:
    """relation, bytes out of (relation, column_name, type, row_count) and (type, width): NULL if any width is unknown."""
    met = columns.join(widths, "type", "left")
    return met.groupBy("relation").agg(F.when(F.bool_and(F.col("width").isNotNull()), F.sum(F.col("width") * F.col("row_count"))).alias("bytes"))


def build_coverage(models: DataFrame, tests: DataFrame, outcomes: DataFrame, edges: DataFrame, began, ended) -> DataFrame:
    """One row: models, models_skipped, models_with_a_test_declared, models_an_assertion_ran_on, tests_declared, tests_that_ran, tests_that_did_not_run.

    Of a unit's outcomes (unit, status, at) the last one in [began, ended] counts. A model that failed keeps all that lie behind
    it from running, so what they or their tests left from before is no outcome of this build. ``models``: node; ``tests``: test,
    attached (NULL: to no model). A test ran if its last outcome is pass, warn, fail or error; a skipped one did not.
    """
    last = Window.partitionBy("unit").orderBy(F.col("at").desc(), "status")
    now = outcomes.where(F.col("at").between(began, ended)).withColumn("k", F.row_number().over(last)).where("k = 1").select("unit", "status")
    failed = models.join(now.where(F.col("status").isin("fail", "error")), models["node"] == now["unit"]).select("node")
    skipped = cut(reached_from(failed, edges).select("node").join(models, "node", "left_semi"))
    state = models.join(skipped.withColumn("skipped", F.lit(True)), "node", "left")
    ran = now.where(F.col("status").isin("pass", "warn", "fail", "error")).select(F.col("unit").alias("test"), F.lit(True).alias("ran"))
    told = tests.join(ran, "test", "left").join(skipped.select(F.col("node").alias("attached"), F.lit(True).alias("behind")), "attached", "left")
    told = told.withColumn("ran", F.coalesce("ran", F.lit(False)) & F.col("behind").isNull())
    by_model = told.where("attached is not null").groupBy(F.col("attached").alias("node")).agg(F.max("ran").alias("asserted"))
    of_models = state.join(by_model, "node", "left").agg(
        F.count("*").alias("models"), F.count("skipped").alias("models_skipped"), F.count("asserted").alias("models_with_a_test_declared"), F.count(F.when(F.col("asserted"), 1)).alias("models_an_assertion_ran_on")
    )
    of_tests = told.agg(F.count("*").alias("tests_declared"), F.count(F.when(F.col("ran"), 1)).alias("tests_that_ran"), F.count(F.when(~F.col("ran"), 1)).alias("tests_that_did_not_run"))
    both = of_models.withColumn("one", F.lit(1)).join(of_tests.withColumn("one", F.lit(1)), "one")
    return both.drop("one")


def uncertainty(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, gate: float = 0.6) -> DataFrame:
    """model, marts, answers, mean_confidence, under_the_gate: models by what rests on answers that nobody is sure of.

    ``decisions``: decision_key (a model, or a model with ``::`` and more), question, confidence, decided_at. The last decision
    of a key and question counts, if it has a confidence. Marts are counted by walks from the answered models only.
    """
    last = Window.partitionBy("decision_key", "question").orderBy(F.col("decided_at").desc(), F.col("confidence").asc_nulls_first())
    live = decisions.withColumn("k", F.row_number().over(last)).where("k = 1 and confidence is not null")
    answered = cut(live.groupBy(F.substring_index("decision_key", "::", 1).alias("model")).agg(F.count("*").alias("answers"), F.avg("confidence").alias("mean_confidence"), F.count(F.when(F.col("confidence") < gate, 1)).alias("under_the_gate")))
    known = answered.join(nodes.select(F.col("node").alias("model")), "model", "left_semi")
    behind = reach(known.select(F.col("model").alias("node")), edges).join(nodes.where("kind = 'mart'").select(F.col("node").alias("reached")), "reached", "left_semi")
    marts = behind.groupBy(F.col("node").alias("model")).agg(F.count("*").alias("marts"))
    return known.join(marts, "model", "left").select("model", F.coalesce("marts", F.lit(0).cast("long")).alias("marts"), "answers", "mean_confidence", "under_the_gate").orderBy(F.col("under_the_gate").desc(), F.col("marts").desc(), "model")


def join_surface(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """model, hops, distinct_keysets, columns_dropped of the last run that has facts: (run_id, child, joined_on array, dropped).

    Key sets are compared in canonical form: lower case, sorted, without repeats. A hop without a join key counts as a hop only.
    """
    last = runs.join(facts.select("run_id").distinct(), "run_id", "left_semi").orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1).select("run_id")
    keys = F.array_sort(F.array_distinct(F.transform("joined_on", lambda c: F.lower(c))))
    now = facts.join(F.broadcast(last), "run_id", "left_semi").withColumn("keys", F.when(F.size("joined_on") > 0, F.array_join(keys, ",")))  # one row
    out = now.groupBy(F.col("child").alias("model")).agg(F.count("*").alias("hops"), F.countDistinct("keys").alias("distinct_keysets"), F.sum("dropped").alias("columns_dropped"))
    return out.orderBy(F.col("distinct_keysets").desc(), F.col("hops").desc(), "model")


def outrun_tests(tests: DataFrame, lineage: DataFrame, measured: DataFrame) -> DataFrame:
    """column, origin, hops, nulls, n: not-null tests on columns that can be NULL by lineage, each with its nearest origin (ties: the least name).

    ``lineage``: column, parent, carried, guarded. A column that carries its parent can be NULL where the parent can, unless the step
    is guarded (a COALESCE, a filter). ``measured``: column, nulls, n; a column with counted NULLs is an origin, and a
    column that was counted and has none stops the walk, whatever stands before it.
    """
    steps = lineage.where("carried and not guarded").select(F.col("parent").alias("src"), F.col("column").alias("dst"))
    origins, proven = measured.where("nulls > 0"), measured.where("nulls = 0").select(F.col("column").alias("node"))
    walked = reach(origins.select(F.col("column").alias("node")), steps, proven).select(F.col("node").alias("origin"), F.col("reached").alias("column"), "hops")
    own = origins.select(F.col("column").alias("origin"), "column", F.lit(0).alias("hops"))
    nearest = tests.select("column").join(walked.union(own), "column").groupBy("column").agg(F.min(F.struct("hops", "origin")).alias("near"))
    return nearest.select("column", "near.origin", "near.hops").join(origins.select(F.col("column").alias("origin"), "nulls", "n"), "origin")
