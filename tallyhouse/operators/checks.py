"""Named checks over a project's facts. Every check is a DataFrame of findings (check_name, subject, detail).

Inputs are plain DataFrames: ``nodes`` (node, kind, layer, materialized, path, access, description, has_contract,
freshness, physical_name), ``edges`` (src, dst), ``digests`` (see ``plans.digest``), ``columns`` (node, column_name, type,
description), ``tests`` (test_id, node, column_name, kind), ``results`` (test_id, status, ran_at). A check whose
input is absent is listed as unchecked by ``run_all`` and never counts as passed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Layers in the order in which data flows.
LAYERS = ("source", "staging", "intermediate", "mart")


def _finding(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def pattern_checks(p: dict[str, DataFrame]) -> DataFrame:
    """All smells that one text shows by itself."""
    rows = p["digests"].select("model", F.explode("patterns").alias("pattern")).where("pattern <> 'union_distinct'")
    return rows.select(F.col("pattern").alias("check_name"), F.col("model").alias("subject"), F.lit("").alias("detail"))


def evaluator_rule(p):
    rows = p["digests"].where("not readable")
    return _finding(rows, "unreadable", F.col("model"), F.col("reason"))


def test_cannot_fail(p):
    """A test of a column that its text makes pass: not_null over a defaulted or constant column, unique over row_number or the group key."""
    outs = p["digests"].select("model", F.explode(F.arrays_zip("outputs", "roots")).alias("o"), "unique_on").select("model", F.col("o.outputs").alias("column_name"), F.col("o.roots").alias("root"), "unique_on")
    met = p["tests"].join(outs, (F.col("node") == F.col("model")) & (p["tests"]["column_name"] == outs["column_name"])).select("test_id", "node", "kind", "root", "unique_on", outs["column_name"])
    sure = ((F.col("kind") == "not_null") & F.col("root").isin("coalesce:literal", "literal", "window:row_number", "agg:count")) | ((F.col("kind") == "unique") & ((F.col("root") == "window:row_number") | (F.col("unique_on") == F.array("column_name"))))
    return _finding(met.where(sure), "test_cannot_fail", F.col("test_id"), F.col("root"))


def latest_results(results: DataFrame) -> DataFrame:
    window = Window.partitionBy("test_id").orderBy(F.col("ran_at").desc(), "status")
    return results.withColumn("k", F.row_number().over(window)).where("k = 1").drop("k")


def test_is_failing(p):
    return _finding(latest_results(p["results"]).where(F.col("status").isin("fail", "error")), "test_is_failing", F.col("test_id"), F.col("status"))


def test_skipped(p):
    return _finding(latest_results(p["results"]).where("status = 'skipped'"), "test_skipped_rather_than_passed", F.col("test_id"), F.col("ran_at"))


def test_never_run(p):
    return _finding(p["tests"].join(p["results"].select("test_id"), "test_id", "left_anti"), "test_declared_but_never_run", F.col("test_id"), F.col("node"))


def no_primary_key_test(p):
    keyed = p["tests"].where(F.col("kind").isin("unique", "unique_combination")).select("node")
    return _finding(p["nodes"].where(F.col("kind") == "model").join(keyed, "node", "left_anti"), "no_primary_key_test", F.col("node"), F.col("layer"))


def column_has_no_description(p):
    bare = p["columns"].where(F.coalesce(F.trim("description"), F.lit("")) == "").groupBy("node").agg(F.count("*").alias("n"))
    return _finding(bare, "column_has_no_description", F.col("node"), F.col("n"))


def models_disagree(p):
    norm = F.trim(F.regexp_replace(F.lower("description"), "[^a-z0-9]+", " "))
    told = p["columns"].where(norm != "").groupBy("column_name").agg(F.countDistinct(norm).alias("n"), F.countDistinct("node").alias("models")).where("n > 1")
    return _finding(told, "models_disagree_about_a_column", F.col("column_name"), F.col("models"))


def name_states_type(p):
    name, kind = F.col("column_name"), F.col("type")
    wrong = ((kind == "boolean") & ~name.rlike("^(is|has|was|can|should|did)_")) | ((kind == "date") & ~name.rlike("(_date|_day|_on)$|^date_")) | (kind.startswith("timestamp") & ~name.rlike("(_at|_ts|_time|_timestamp)$"))
    told = p["columns"].where(wrong).groupBy("node").agg(F.concat_ws(",", F.sort_array(F.collect_set("column_name"))).alias("cols"))
    return _finding(told, "column_name_does_not_state_its_type", F.col("node"), F.col("cols"))


def promises(p):
    outs = p["digests"].select("model", F.explode(F.arrays_zip("outputs", "roots")).alias("o")).select(F.col("model").alias("node"), F.col("o.outputs").alias("column_name"), F.col("o.roots").alias("root"))
    met = p["columns"].join(outs, ["node", "column_name"]).where(F.lower("description").rlike("never null|always set|unique") & F.col("root").isin("column", "expression", "case", "null"))
    return _finding(met, "description_promises_what_the_column_cannot_keep", F.concat_ws(".", "node", "column_name"), F.col("root"))


def float_sum(p):
    """SUM or AVG over a float column in a mart: the total depends on the order of rows."""
    outs = p["digests"].select("model", F.explode(F.arrays_zip("outputs", "roots")).alias("o")).select(F.col("model").alias("node"), F.col("o.outputs").alias("column_name"), F.col("o.roots").alias("root"))
    met = outs.where(F.col("root").isin("agg:sum", "agg:avg")).join(p["columns"].where(F.col("type").isin("double", "float")), ["node", "column_name"]).join(p["nodes"].where("layer = 'mart'").select("node"), "node")
    return _finding(met, "float_sum_is_not_reproducible", F.concat_ws(".", "node", "column_name"), F.col("root"))


def _no_children(p, kind: str, check: str) -> DataFrame:
    return _finding(p["nodes"].where(F.col("kind") == kind).join(p["edges"].select(F.col("src").alias("node")), "node", "left_anti"), check, F.col("node"), F.lit("no children"))


def only_a_test_reads(p):
    kinds = p["nodes"].select(F.col("node").alias("dst"), F.col("kind").alias("child"))
    told = p["edges"].join(kinds, "dst").groupBy("src").agg(F.bool_and(F.col("child") == "test").alias("only"))
    return _finding(told.where("only").join(p["nodes"].where("kind = 'source'").select(F.col("node").alias("src")), "src"), "source_only_a_test_reads", F.col("src"), F.lit(""))


def freshness_undeclared(p):
    return _finding(p["nodes"].where("kind = 'source' and freshness is null"), "source_freshness_undeclared", F.col("node"), F.lit(""))


def exposure_undeclared(p):
    return _finding(p["nodes"].where("kind = 'model' and layer = 'mart'").join(p["edges"].select(F.col("src").alias("node")), "node", "left_anti"), "exposure_undeclared", F.col("node"), F.lit("a mart that nothing reads"))


def no_description(p):
    rows = p["nodes"].where(F.col("kind").isin("model", "source") & (F.coalesce(F.trim("description"), F.lit("")) == ""))
    return _finding(rows, "no_description", F.col("node"), F.col("kind"))


def many_leaf_children(p, least: int = 3):
    """Models of which ``least`` or more direct children are models that no model reads."""
    models = p["nodes"].where("kind = 'model'")
    within = p["edges"].select("src", "dst").distinct().join(models.select(F.col("node").alias("src")), "src", "left_semi").join(models.select(F.col("node").alias("dst")), "dst", "left_semi")
    leaves = within.join(within.select(F.col("src").alias("dst")), "dst", "left_anti")
    return _finding(leaves.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= least), "model_has_many_leaf_children", F.col("src"), F.col("n"))


def declared_twice(p):
    told = p["nodes"].where("kind = 'source'").groupBy("physical_name").agg(F.count("*").alias("n")).where("n > 1")
    return _finding(told, "source_declared_twice", F.col("physical_name"), F.col("n"))


def _layered(p) -> DataFrame:
    side = lambda end: p["nodes"].select(F.col("node").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("layer").alias(f"{end}_layer"))
    return p["edges"].join(side("src"), "src").join(side("dst"), "dst").where("dst_kind = 'model'")


def reads_raw_source(p):
    return _finding(_layered(p).where("src_kind = 'source' and dst_layer <> 'staging'"), "reads_raw_source_outside_staging", F.col("dst"), F.col("src"))


def staging_reads_staging(p):
    return _finding(_layered(p).where("src_layer = 'staging' and dst_layer = 'staging'"), "staging_reads_staging", F.col("dst"), F.col("src"))


def staging_reads_downstream(p):
    return _finding(_layered(p).where("src_layer in ('intermediate', 'mart') and dst_layer = 'staging'"), "staging_reads_downstream", F.col("dst"), F.col("src"))


def rejoins_upstream(p):
    return _finding(graph.rejoined(p["edges"]), "rejoins_an_upstream_concept", F.col("c"), F.col("a"))


def many_views_read(p, least: int = 5):
    views = p["nodes"].where("materialized = 'view'").select(F.col("node").alias("src"))
    told = p["edges"].join(views, "src").groupBy("src").agg(F.countDistinct("dst").alias("n")).where(F.col("n") >= least)
    return _finding(told, "view_read_by_many_models", F.col("src"), F.col("n"))


def source_fanout(p, least: int = 3):
    sources = p["nodes"].where("kind = 'source'").select(F.col("node").alias("src"))
    told = p["edges"].join(sources, "src").groupBy("src").agg(F.countDistinct("dst").alias("n")).where(F.col("n") >= least)
    return _finding(told, "source_read_directly_by_many_models", F.col("src"), F.col("n"))


def long_chain(p, least: int = 4):
    return _finding(graph.view_chains(p["nodes"], p["edges"], least), "long_chain_of_views", F.col("node"), F.col("length"))


def refs_nothing(p):
    return _finding(p["nodes"].where("kind = 'model'").join(p["edges"].select(F.col("dst").alias("node")), "node", "left_anti"), "model_refs_nothing", F.col("node"), F.lit(""))


def hard_coded(p):
    """Relations in a text that are neither nodes nor physical names of nodes."""
    read = p["digests"].select("model", F.explode("relations").alias("name"))
    known = p["nodes"].select(F.lower("node").alias("k")).union(p["nodes"].select(F.lower("physical_name").alias("k"))).where("k is not null").distinct()
    return _finding(read.join(known, F.lower("name") == F.col("k"), "left_anti"), "hard_coded_reference", F.col("model"), F.col("name"))


def many_joins(p, least: int = 7):
    return _finding(p["digests"].where(F.size("joins") >= least), "too_many_joins", F.col("model"), F.size("joins"))


def public_contract(p):
    return _finding(p["nodes"].where("access = 'public' and not coalesce(has_contract, false)"), "public_model_without_contract", F.col("node"), F.lit(""))


def exposure_rests_on(p):
    up = p["edges"].join(p["nodes"].where("kind = 'exposure'").select(F.col("node").alias("dst")), "dst").join(p["nodes"].select(F.col("node").alias("src"), "materialized", "access"), "src")
    views = _finding(up.where("materialized = 'view'"), "exposure_rests_on_views", F.col("dst"), F.col("src"))
    return views.union(_finding(up.where("access = 'private'"), "exposure_rests_on_private_models", F.col("dst"), F.col("src")))


def naming(p):
    prefix = F.create_map(*[F.lit(x) for pair in (("staging", "stg_"), ("intermediate", "int_")) for x in pair])[F.col("layer")]
    rows = p["nodes"].where("kind = 'model'").withColumn("prefix", prefix).where(F.col("prefix").isNotNull() & ~F.col("node").startswith(F.col("prefix")))
    names = _finding(rows, "model_name_breaks_convention", F.col("node"), F.col("prefix"))
    lost = p["nodes"].where((F.col("kind") == "model") & F.col("layer").isin("staging", "intermediate") & ~F.contains(F.col("path"), F.col("layer")))
    return names.union(_finding(lost, "file_in_unexpected_directory", F.col("node"), F.col("path")))


def join_fans_out(p):
    """Joins that cover part of the parent's declared key."""
    keys = p["tests"].where("kind in ('unique', 'unique_combination')").groupBy(F.col("node").alias("relation")).agg(F.collect_set("column_name").alias("parent_key"))
    joins = p["digests"].select(F.col("model").alias("child"), F.explode("joins").alias("j")).where("j.is_equi").select("child", F.col("j.relation").alias("relation"), F.col("j.right_keys").alias("joined_on"))
    return _finding(graph.partial_key_joins(joins.join(keys, "relation")), "join_fans_out", F.col("child"), F.col("relation"))


def predicate_clusters(digests: DataFrame) -> DataFrame:
    """shape, coarse, models: predicate shapes held by three models or more."""
    rows = digests.select("model", F.explode(F.arrays_zip("shapes", "coarse_shapes")).alias("s")).select("model", F.col("s.shapes").alias("shape"), F.col("s.coarse_shapes").alias("coarse"))
    return rows.groupBy("shape", "coarse").agg(F.countDistinct("model").alias("models"))


def repeated_rule(p):
    return _finding(predicate_clusters(p["digests"]).where("models >= 3"), "one_rule_or_a_coincidence", F.col("shape"), F.col("models"))


def odd_one_out(p):
    """A fine shape that differs from one held by two models or more and by more than half of its coarse family."""
    held = predicate_clusters(p["digests"])
    family = Window.partitionBy("coarse")
    told = held.withColumn("total", F.sum("models").over(family)).withColumn("most", F.max("models").over(family))
    return _finding(told.where("most >= 2 and 2 * most > total and models < most"), "the_odd_one_out", F.col("shape"), F.col("coarse"))


#: Each check with the inputs it needs.
CHECKS: dict[str, tuple[Callable[[dict[str, DataFrame]], DataFrame], tuple[str, ...]]] = {
    "patterns": (pattern_checks, ("digests",)), "unreadable": (evaluator_rule, ("digests",)), "test_cannot_fail": (test_cannot_fail, ("digests", "tests")),
    "test_is_failing": (test_is_failing, ("results",)), "test_skipped_rather_than_passed": (test_skipped, ("results",)), "test_declared_but_never_run": (test_never_run, ("tests", "results")),
    "no_primary_key_test": (no_primary_key_test, ("nodes", "tests")), "column_has_no_description": (column_has_no_description, ("columns",)), "models_disagree_about_a_column": (models_disagree, ("columns",)),
    "column_name_does_not_state_its_type": (name_states_type, ("columns",)), "description_promises_what_the_column_cannot_keep": (promises, ("columns", "digests")), "float_sum_is_not_reproducible": (float_sum, ("digests", "columns", "nodes")),
    "source_reaches_nothing": (lambda p: _no_children(p, "source", "source_reaches_nothing"), ("nodes", "edges")), "seed_reaches_nothing": (lambda p: _no_children(p, "seed", "seed_reaches_nothing"), ("nodes", "edges")),
    "source_only_a_test_reads": (only_a_test_reads, ("nodes", "edges")), "source_freshness_undeclared": (freshness_undeclared, ("nodes",)), "exposure_undeclared": (exposure_undeclared, ("nodes", "edges")), "no_description": (no_description, ("nodes",)),
    "model_has_many_leaf_children": (many_leaf_children, ("nodes", "edges")),
    "source_declared_twice": (declared_twice, ("nodes",)), "reads_raw_source_outside_staging": (reads_raw_source, ("nodes", "edges")), "staging_reads_staging": (staging_reads_staging, ("nodes", "edges")), "staging_reads_downstream": (staging_reads_downstream, ("nodes", "edges")),
    "rejoins_an_upstream_concept": (rejoins_upstream, ("edges",)), "view_read_by_many_models": (many_views_read, ("nodes", "edges")), "source_read_directly_by_many_models": (source_fanout, ("nodes", "edges")), "long_chain_of_views": (long_chain, ("nodes", "edges")),
    "model_refs_nothing": (refs_nothing, ("nodes", "edges")), "hard_coded_reference": (hard_coded, ("digests", "nodes")), "too_many_joins": (many_joins, ("digests",)), "public_model_without_contract": (public_contract, ("nodes",)),
    "exposure_rests_on": (exposure_rests_on, ("nodes", "edges")), "naming": (naming, ("nodes",)), "join_fans_out": (join_fans_out, ("digests", "tests")), "one_rule_or_a_coincidence": (repeated_rule, ("digests",)), "the_odd_one_out": (odd_one_out, ("digests",)),
}


def _simple(check: str, table: str, condition: str, subject: str, detail: str = "''") -> None:
    """A check that is a filter over one facts table."""
    CHECKS[check] = (lambda p: _finding(p[table].where(F.expr(condition)), check, F.expr(subject), F.expr(detail)), (table,))


# ``incrementals``: node, strategy, unique_key, filter_column, subtracts, lookback_seconds, max_late_seconds, n_repeated, columns_now, columns_before.
_simple("incremental_merge_without_key", "incrementals", "strategy in ('merge', 'delete+insert') and unique_key is null", "node", "strategy")
_simple("incremental_key_not_unique", "incrementals", "unique_key is not null and coalesce(n_repeated, 1) > 0", "node", "coalesce(cast(n_repeated as string), 'uncounted')")
_simple("incremental_filter_without_lookback", "incrementals", "filter_column is not null and not coalesce(subtracts, false) and coalesce(max_late_seconds, 1) > 0", "node", "filter_column")
_simple("lookback_shorter_than_lateness", "incrementals", "subtracts and max_late_seconds > lookback_seconds", "node", "concat(max_late_seconds, '>', lookback_seconds)")
_simple("microbatch_without_lookback", "incrementals", "strategy = 'microbatch' and (coalesce(lookback_seconds, 0) = 0 or max_late_seconds > lookback_seconds)", "node", "cast(lookback_seconds as string)")
_simple("incremental_schema_change_ignored", "incrementals", "size(array_except(columns_now, columns_before)) + size(array_except(columns_before, columns_now)) > 0", "node", "array_join(array_except(columns_now, columns_before), ',')")
# ``premises``: premise_id, status, was.
_simple("guarantee_does_not_hold", "premises", "status = 'broken'", "premise_id", "coalesce(was, 'new')")
_simple("guarantee_lost", "premises", "status = 'broken' and was = 'holding'", "premise_id", "was")
# ``judgments``: node, column_name, role, p, in_grain, declared_in_key.
_simple("identifier_outside_grain", "judgments", "role = 'identifier' and not in_grain", "concat_ws('.', node, column_name)")
_simple("measure_inside_grain", "judgments", "role = 'measure' and in_grain", "concat_ws('.', node, column_name)")
_simple("grain_contradicts_test", "judgments", "in_grain <> declared_in_key", "concat_ws('.', node, column_name)", "cast(declared_in_key as string)")
_simple("grain_unresolved", "judgments", "p > 0.35 and p < 0.70", "concat_ws('.', node, column_name)", "cast(p as string)")
# ``freshness``: node, status, days_since_result.
_simple("source_freshness_stale", "freshness", "status in ('warn', 'error', 'fail')", "node", "status")
CHECKS["source_freshness_not_run"] = (lambda p: _finding(p["freshness"].agg(F.max("days_since_result").alias("d"), F.count("*").alias("n")).where("n > 0 and coalesce(d, 8) > 7"), "source_freshness_not_run", F.lit("project"), F.col("d")), ("freshness",))
# ``hops``: hop, ratio, kept, lost_share, lost (see ``quality``).
_simple("hop_multiplies_rows", "hops", "ratio > 1", "hop", "cast(ratio as string)")
_simple("hop_drops_most_rows", "hops", "kept < 0.2", "hop", "cast(kept as string)")
_simple("values_lost_at_hop", "hops", "lost > 0", "hop", "cast(lost_share as string)")
# ``monitors``: monitor, state; ``reach``: node, marts, watched; ``outside``: relation, known, file.
_simple("monitor_declared_but_never_run", "monitors", "state = 'never_run'", "monitor")
_simple("monitor_ran_then_stopped", "monitors", "state = 'abandoned'", "monitor")
_simple("volume_is_not_being_watched", "reach", "marts >= 1 and not watched", "node", "cast(marts as string)")
_simple("source_volume_not_monitored", "reach", "kind = 'source' and marts >= 1 and not watched", "node", "cast(marts as string)")
_simple("read_outside_dbt_undeclared", "outside", "not known", "relation", "file")
_simple("sql_outside_dbt", "outside", "true", "file", "relation")
_simple("narrow_read", "hop_columns", "available >= 5 and dropped >= 0.8 * available", "concat_ws('>', src, dst)", "cast(dropped as string)")
# ``answers``: subject, claim, contradicts; ``config_claims``: subject, claimed, counted; ``returned``: identity, state.
_simple("code_contradicts_a_claim", "answers", "contradicts and source = 'claim'", "subject", "claim")
_simple("description_contradicts_the_code", "answers", "contradicts and source = 'description'", "subject", "claim")
_simple("config_comment_contradicts_the_store", "config_claims", "claimed <> counted", "subject", "concat(claimed, '<>', counted)")
_simple("fixed_finding_returned", "returned", "state = 'returned'", "identity")


def run_all(project: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """All findings, and the checks that could not run because an input is absent."""
    unchecked = [name for name, (_, needs) in CHECKS.items() if any(n not in project for n in needs)]
    parts = [check(project) for name, (check, _) in CHECKS.items() if name not in unchecked]
    if not parts:
        raise ValueError("no check has its inputs")
    return reduce(DataFrame.union, parts), unchecked
