"""Deciding what to count next, and what a counted or judged answer settles."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import count
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import graph, quality, rules
from .similar import similar_sets

#: A value-loss count older than this is due again.
RECOUNT_DAYS = 7


class Budget:
    """Stops before a statement that would pass the limits; what was not sent is told, not skipped in silence."""

    def __init__(self, statements: int | None = None, usd: float | None = None):
        self.statements, self.usd, self.sent, self.spent, self.refused = statements, usd, 0, 0.0, 0

    def allow(self, usd: float = 0.0) -> bool:
        over = (self.statements is not None and self.sent + 1 > self.statements) or (self.usd is not None and self.spent + usd > self.usd)
        if over:
            self.refused += 1
            return False
        self.sent, self.spent = self.sent + 1, self.spent + usd
        return True


def recount_due(candidates: DataFrame, counted: DataFrame, today) -> DataFrame:
    """relation, column_key, why: new candidates, moved fingerprints, and counts of seven days or more; the oldest first."""
    last = counted.select("relation", "column_key", F.col("fingerprint").alias("was"), "counted_at")
    met = candidates.join(last, ["relation", "column_key"], "left")
    old = F.datediff(F.lit(today).cast("date"), F.to_date("counted_at"))
    why = F.when(F.col("counted_at").isNull(), "new").when(~F.col("was").eqNullSafe(F.col("fingerprint")), "moved").when(old >= RECOUNT_DAYS, "old")
    return met.withColumn("why", why).where("why is not null").select("relation", "column_key", "why", "counted_at").orderBy(F.col("counted_at").asc_nulls_first(), "relation", "column_key")


def row_counts(observed: DataFrame) -> DataFrame:
    """relation, row_count: the latest count of each column, then the largest of a relation."""
    window = Window.partitionBy("relation", "column_name").orderBy(F.col("observed_at").desc(), F.col("row_count").desc())
    return observed.withColumn("k", F.row_number().over(window)).where("k = 1").groupBy("relation").agg(F.max("row_count").alias("row_count"))


def probe_targets(digests: DataFrame, schema: DataFrame, most: int = 12) -> DataFrame:
    """(relation, column_name): join, window and group columns that exist, else columns that look like ids; at most ``most`` a relation."""
    keys = digests.select("model", F.explode("joins").alias("j")).select(F.col("j.relation").alias("relation"), F.explode("j.right_keys").alias("column_name"))
    own = digests.select(F.explode("relations").alias("relation"), F.array_union("group_keys", F.flatten(F.transform("windows", lambda w: w["partition"]))).alias("c")).select("relation", F.explode("c").alias("column_name"))
    asked = keys.union(own).distinct().join(schema.select("relation", "column_name"), ["relation", "column_name"], "left_semi")
    like_ids = schema.where(F.col("column_name").rlike("(^|_)(id|key)$")).select("relation", "column_name").join(asked.select("relation"), "relation", "left_anti")
    window = Window.partitionBy("relation").orderBy("column_name")
    return asked.union(like_ids).withColumn("k", F.row_number().over(window)).where(F.col("k") <= most).drop("k")


def ranked_findings(findings: DataFrame, reach: DataFrame) -> DataFrame:
    """Findings (check_name, subject, base) by weight = base x lift of what lies behind the subject."""
    met = findings.join(reach.withColumnRenamed("node", "subject"), "subject", "left").na.fill(0, ["descendants", "marts", "exposures"])
    weight = F.col("base") * graph.lift(F.col("descendants"), F.col("marts"), F.col("exposures"))
    return met.withColumn("weight", F.round(weight, 6)).orderBy(F.col("weight").desc(), "check_name", "subject")


def priority(findings: DataFrame) -> DataFrame:
    """Column ``tier`` (paid 0, harm 1, reach 2, other 3) of findings (costs, harms, marts), in the order of work."""
    tier = F.when(F.col("costs") > 0, 0).when(F.col("harms"), 1).when(F.col("marts") > 0, 2).otherwise(3)
    return findings.withColumn("tier", tier).orderBy("tier", F.col("costs").desc(), F.col("marts").desc(), "check_name", "subject")


def key_from_answers(answers: DataFrame) -> DataFrame:
    """model, key, uncertain out of (model, column_name, p): keep at 0.70 and above, drop at 0.35 and below, keep and mark between; no answer keeps; a key is never empty."""
    kept = answers.where(F.col("p").isNull() | (F.col("p") > 0.35))
    told = kept.groupBy("model").agg(F.sort_array(F.collect_set("column_name")).alias("key"), F.sort_array(F.collect_set(F.when((F.col("p") > 0.35) & (F.col("p") < 0.70), F.col("column_name")))).alias("uncertain"))
    every = answers.groupBy("model").agg(F.sort_array(F.collect_set("column_name")).alias("all_columns"))
    met = every.join(told, "model", "left")
    return met.select("model", F.coalesce("key", "all_columns").alias("key"), F.coalesce("uncertain", F.lit([]).cast("array<string>")).alias("uncertain"))


def grain_candidates(digests: DataFrame, declared: DataFrame) -> DataFrame:
    """model, route, key: a declared key first, then what makes the rows unique; without either the grain must be probed."""
    met = digests.select("model", "unique_kind", "unique_on").join(declared.select(F.col("node").alias("model"), F.col("key").alias("declared")), "model", "left")
    route = F.when(F.col("declared").isNotNull(), "declared").when(F.col("unique_kind").isNotNull() & ~F.array_contains("unique_on", "?"), F.col("unique_kind")).otherwise("probe")
    return met.select("model", route.alias("route"), F.when(route == "declared", F.col("declared")).when(route != "probe", F.col("unique_on")).alias("key"))


def propagate_grain(candidates: DataFrame, drivers: DataFrame, levels: int | None = None) -> DataFrame:
    """Grain passed on from a single driving parent whose joins do not multiply: (model, parent, safe); parents first.

    Walks until no model gains a grain, with lineage cut at each level; raises where a given number of levels does not reach that.
    """
    known = cut(candidates.select("model", "key", "route"))
    n = known.where("key is not null").count()
    for level in count(1):
        up = known.where("key is not null").select(F.col("model").alias("parent"), F.col("key").alias("parent_key"))
        met = known.join(drivers.where("safe").select("model", "parent"), "model", "left").join(up, "parent", "left")
        known = cut(met.select("model", F.coalesce("key", "parent_key").alias("key"), F.when(F.col("key").isNull() & F.col("parent_key").isNotNull(), "inherited").otherwise(F.col("route")).alias("route")))
        before, n = n, known.where("key is not null").count()
        if n == before:
            return known
        if levels is not None and level > levels:
            raise RuntimeError(f"the lineage is deeper than {levels} levels")


def declared_keys(tests: DataFrame) -> DataFrame:
    """node, key: columns of unique tests; a single unique column before a combination."""
    single = tests.where("kind = 'unique'").groupBy("node").agg(F.array(F.min("column_name")).alias("one"))
    many = tests.where("kind = 'unique_combination'").groupBy("node").agg(F.sort_array(F.collect_set("column_name")).alias("many"))
    return single.join(many, "node", "full").select("node", F.coalesce("one", "many").alias("key"))


def unwatched(reach: DataFrame, watched: DataFrame, least_marts: int = 1) -> DataFrame:
    """Nodes that reach marts and have no monitoring history, by marts reached."""
    return reach.where(F.col("marts") >= least_marts).join(watched.select("node"), "node", "left_anti").orderBy(F.col("marts").desc(), "node")


def reason_pairs(rulings: DataFrame, most: int) -> DataFrame:
    """Unordered pairs of rulings of one family whose normalised reasons differ: (id_a, id_b), the first ``most`` of a report.

    A pair whose first place in the family is beyond ``most``, or whose places are further apart than that, has ``most`` pairs before it.
    """
    norm = F.trim(F.regexp_replace(F.lower("reason"), "[^a-z0-9]+", " "))
    distinct = rulings.groupBy("family", norm.alias("reason")).agg(F.min("id").alias("id"))
    # Ties of ids (an id with several reasons) share a rank and so are kept together.
    first = distinct.withColumn("place", F.dense_rank().over(Window.partitionBy("family").orderBy("id"))).where(F.col("place") <= 2 * most)
    a, b = first.alias("a"), first.alias("b")
    return a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.family").alias("family"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).orderBy("family", "id_a", "id_b").limit(most)


def claim_pairs(claims: DataFrame, least: float = 0.5, most: int = 150) -> DataFrame:
    """Pairs of claims (claim_id, subject, text) of different subjects with word sets that overlap; identical texts are settled by code and left out.

    Only distinct texts are split and only distinct word sets compared. Pairs come by score, then by their lesser id: a
    claim that is the lesser one of any pair of a score stands for one pair at least, so the first ``most`` such claims
    hold the first ``most`` pairs, and only they meet their partners.
    """
    claims = claims.select("claim_id", "subject", "text").where("claim_id is not null and subject is not null")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    texts = cut(claims.select("text").distinct().select("text", F.array_sort(words).alias("words"))).where(F.size("words") >= 3)
    scored = similar_sets(texts.select(F.col("words").alias("key"), F.col("words").alias("items")).distinct(), least).where(F.col("score") < 1)
    both = F.array(*[F.struct(F.col(f"key_{x}").alias("words"), F.col(f"key_{y}").alias("met")) for x, y in ("ab", "ba")])
    scored = cut(scored.select(F.explode(both).alias("p"), "score").select("p.words", "p.met", "score"))
    # The last id of any subject but one is among those of the two subjects with the largest last ids.
    two = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("last").desc()))).where("k <= 2").drop("k")
    last = claims.groupBy("text", "subject").agg(F.max("claim_id").alias("last")).join(texts, "text").groupBy("words", "subject").agg(F.max("last").alias("last"))
    reached = scored.join(two(last, "words").withColumnRenamed("words", "met"), "met").groupBy("words", "score", "subject").agg(F.max("last").alias("last"))
    reached = texts.join(two(reached, "words", "score"), "words").select("text", "score", F.col("subject").alias("s_last"), "last")
    lesser = claims.join(reached, "text").where("subject <> s_last and claim_id < last").select("score", "claim_id").distinct().orderBy(F.col("score").desc(), "claim_id").limit(most)
    first = claims.join(lesser, "claim_id").join(texts, "text").join(scored, ["words", "score"]).select("score", F.col("claim_id").alias("id_a"), F.col("subject").alias("s_a"), F.col("met").alias("words"))
    pairs = first.join(texts, "words").join(claims, "text").where("subject <> s_a and claim_id > id_a")
    return pairs.select("id_a", F.col("claim_id").alias("id_b"), "score").orderBy(F.col("score").desc(), "id_a", "id_b").limit(most)


def sentences(texts: DataFrame) -> DataFrame:
    """(subject, sentence) of prose, in order; fragments of fewer than three words are no claims."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.size(F.split(s, r"\s+")) >= 3)
    return texts.select("subject", F.posexplode(parts).alias("n", "sentence"))


class Scorer(Protocol):
    """Answers judged questions: states in, (answer, probability) out. The default never asks anyone."""

    def score(self, states: pd.Series) -> pd.DataFrame: ...


class StubScorer:
    """Deterministic answers by hash, for tests and dry runs."""

    def score(self, states: pd.Series) -> pd.DataFrame:
        p = pd.util.hash_array(states.fillna("").to_numpy(dtype=object)) % 1000 / 1000
        return pd.DataFrame({"answer": ["yes" if x >= 0.5 else "no" for x in p], "p": p})


def judged(states: DataFrame, question: str, version: str, scorer: Scorer | None = None) -> DataFrame:
    """state_hash, question, version, answer, p: each distinct state is asked once, in batches on the executors."""
    scorer = scorer or StubScorer()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = scorer.score(batch["state"])
            yield pd.DataFrame({"state_hash": batch["state_hash"], "question": question, "version": version, "answer": told["answer"].to_numpy(), "p": told["p"].to_numpy()})

    from ..session import ship_package

    ship_package(states.sparkSession)
    distinct = states.select("state").distinct().withColumn("state_hash", F.sha2("state", 256))
    return distinct.mapInPandas(ask, "state_hash string, question string, version string, answer string, p double")


def unanswered(states: DataFrame, answers: DataFrame, question: str, version: str) -> DataFrame:
    """States without a stored answer to this question at this version: only these are asked again."""
    known = answers.where((F.col("question") == question) & (F.col("version") == version)).select("state_hash")
    return states.withColumn("state_hash", F.sha2("state", 256)).join(known, "state_hash", "left_anti")


def obligations(joins: DataFrame, unique: DataFrame, not_null: DataFrame) -> DataFrame:
    """model, rule, premise, have: which law a join of the model needs, and whether its premise is known.

    joins: (model, kind, relation, right_keys); unique, not_null: (relation, columns).
    """
    rule = F.when(F.col("kind") == "left", "left_join_preserves_rows").otherwise("inner_join_no_fanout")
    known = unique.select("relation", F.col("columns").alias("key"))
    met = joins.join(known, "relation", "left").withColumn("covers", F.col("key").isNotNull() & (F.size(F.array_except("key", "right_keys")) == 0))
    return met.groupBy("model", "kind", "relation", "right_keys").agg(F.bool_or("covers").alias("have")).select("model", rule.alias("rule"), F.concat_ws(" ", F.lit("unique"), "relation", F.array_join("right_keys", ",")).alias("premise"), F.coalesce("have", F.lit(False)).alias("have"))


def generated_rows(spark, columns: dict[str, str], unique: list[list[str]], not_null: list[str], n: int, seed: int) -> DataFrame:
    """Random rows that satisfy premises by construction: the first column of each unique key is distinct; others are NULL a quarter of the time."""
    chance = random.Random(seed)
    distinct = {key[0] for key in unique}
    pools = {"long": lambda: chance.choice([0, 1, 2, 2, 3]), "string": lambda: chance.choice(["a", "b", "ab"]), "boolean": lambda: chance.random() < 0.5, "double": lambda: chance.choice([0.0, 1.5, -2.0])}
    rows = []
    for k in range(n):
        row = []
        for name, kind in columns.items():
            if name in distinct:
                row.append(k if kind == "long" else f"u{k}")
            else:
                row.append(None if name not in not_null and chance.random() < 0.25 else pools[kind]())
        rows.append(tuple(row))
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in columns.items()))


def claim_check(build: Callable[[dict[str, DataFrame]], DataFrame], make: Callable[[int], dict[str, DataFrame]], grain: list[str], cases: int = 5) -> str:
    """``holds``, or the first counterexample's number: does a query keep a grain on generated inputs that satisfy its premises?"""
    for seed in range(cases):
        if rules.repeated_keys(build(make(seed)), grain).first()[0]:
            return f"case {seed} repeats its grain"
    return "holds"


def feed_profile(df: DataFrame, columns: list[str], bounds: DataFrame) -> DataFrame:
    """Everything that a feed's numbers say against their names: sentinels and broken bounds."""
    told = quality.profile(df, columns)
    broken = quality.unit_conflicts(told, bounds).select("column_name", F.col("conflict").alias("problem"))
    return broken.union(quality.sentinel_extremes(told).select("column_name", F.concat_ws("=", F.lit("sentinel"), F.col("value").cast("string")).alias("problem")))


def strip_measured(evidence: Column, measured: list[str]) -> Column:
    return F.map_filter(evidence, lambda k, _: ~k.isin(*measured))
