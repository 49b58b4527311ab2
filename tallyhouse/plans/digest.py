"""Facts about SQL texts, read from their trees: one row a text, and a reason where a text cannot be read."""

from __future__ import annotations

from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .syntax import AGGREGATES, ORDER_SENSITIVE, Call, Outside, Query, Relation, Select, parse

#: Functions that read the clock, and functions that normalise a key.
CLOCK = frozenset("now current_date current_timestamp current_time today getdate sysdate localtimestamp".split())
NORMALISERS = frozenset("lower upper trim ltrim rtrim replace regexp_replace cast".split())
RANKING = frozenset("row_number rank dense_rank".split())


def walk(node):
    """All nodes below and including ``node``."""
    yield node
    if is_dataclass(node):
        children = [getattr(node, f.name) for f in fields(node)]
    elif isinstance(node, (tuple, list)):
        children = list(node)
    else:
        children = []
    for child in children:
        if is_dataclass(child) or isinstance(child, (tuple, list)):
            yield from walk(child)


def conjuncts(e) -> list:
    return [] if e is None else conjuncts(e[1]) + conjuncts(e[2]) if isinstance(e, tuple) and e[0] == "and" else [e]


def columns(e) -> list[tuple]:
    return [n for n in walk(e) if isinstance(n, tuple) and len(n) == 3 and n[0] == "col"]


def calls(e) -> list[Call]:
    return [n for n in walk(e) if isinstance(n, Call)]


def root(e) -> str:
    """Where an output comes from: column, literal, agg:sum, window:row_number, coalesce:literal, case, cast, func:..."""
    if isinstance(e, Call):
        if e.over is not None:
            return f"window:{e.name}"
        if e.name in AGGREGATES:
            return f"agg:{e.name}"
        if e.name == "coalesce":
            return "coalesce:literal" if e.args and e.args[-1][0] in ("num", "str", "bool", "typed") else "coalesce"
        return f"func:{e.name}"
    if e[0] in ("num", "str", "bool", "typed", "interval"):
        return "literal"
    return {"col": "column", "null": "null", "case": "case", "cast": root(e[1]) if e[0] == "cast" else "", "star": "star"}.get(e[0], "expression")


def provenance(kind: str) -> str:
    """Class of an output by its root."""
    if kind.startswith("agg:"):
        return "aggregated"
    if kind.startswith("window:"):
        return "ranked" if kind.split(":")[1] in RANKING else "computed"
    return {"literal": "constant", "null": "null_placeholder", "coalesce:literal": "defaulted", "column": "carried", "star": "carried"}.get(kind, "computed")


def output_name(e, alias: str | None) -> str:
    return alias or (e[2] if isinstance(e, tuple) and e[0] == "col" else "*" if isinstance(e, tuple) and e[0] == "star" else "?")


def equi_keys(join) -> list[tuple[str, str]] | None:
    """Column pairs of a join that is a conjunction of equalities; None if it is anything else."""
    if join.using:
        return [(c, c) for c in join.using]
    pairs = []
    for c in conjuncts(join.on):
        if not (isinstance(c, tuple) and c[0] == "cmp" and c[3] == "=" and all(isinstance(s, tuple) and s[0] == "col" for s in c[1:3])):
            return None
        target = join.right.alias or join.right.name
        a, b = (c[1], c[2]) if c[2][1] == target else (c[2], c[1])
        pairs.append((a[2], b[2]))
    return pairs or None


def unique_by(s: Select) -> tuple[str, list[str]] | None:
    """What makes a select's rows unique: group_by, qualify_dedupe, distinct_on or distinct, and by which columns."""
    names = lambda es: [e[2] if isinstance(e, tuple) and e[0] == "col" else "?" for e in es]
    if s.group:
        by_place = [s.items[int(g[1]) - 1][0] if g[0] == "num" and g[1].isdigit() and int(g[1]) <= len(s.items) else g for g in s.group]
        return "group_by", names(by_place)
    pick = pick_of(s)
    if pick:
        return "qualify_dedupe", names(pick.over[0])
    if s.distinct_on:
        return "distinct_on", names(s.distinct_on)
    if s.distinct:
        return "distinct", [output_name(*i) for i in s.items]
    return None


def pick_of(s: Select) -> Call | None:
    """The ranking window that QUALIFY, or a filter over a derived table, holds to 1."""
    e = s.qualify
    if isinstance(e, tuple) and e[0] == "cmp" and e[3] in ("=", "<=") and isinstance(e[1], Call) and e[1].name in RANKING and e[1].over and e[2] == ("num", "1"):
        return e[1]
    inner = s.source.query.first if s.source is not None and s.source.query is not None else None
    if inner is not None:
        ranked = {alias: item for item, alias in inner.items if isinstance(item, Call) and item.name in RANKING and item.over}
        for c in conjuncts(s.where):
            if isinstance(c, tuple) and c[0] == "cmp" and c[3] == "=" and c[2] == ("num", "1") and c[1][0] == "col" and c[1][2] in ranked:
                return ranked[c[1][2]]
    return None


def shape(e, coarse: bool = False) -> str:
    """A predicate with its columns masked, and its literals too in the coarse shape."""
    if isinstance(e, Call):
        return f"{e.name}({','.join(shape(a, coarse) for a in e.args)})"
    if not isinstance(e, tuple):
        return "[" + ",".join(shape(x, coarse) for x in e) + "]" if isinstance(e, list) else str(e)
    if e[0] == "col":
        return "$"
    if coarse and e[0] in ("num", "str", "typed", "interval", "bool"):
        return "?"
    return f"({' '.join(shape(x, coarse) for x in e)})"


def patterns(q: Query) -> list[str]:
    """Named smells of a text, each once."""
    out = set()
    for s in (n for n in walk(q) if isinstance(n, Select)):
        for c in calls(s):
            if c.name in ORDER_SENSITIVE and not c.order and c.over is None:
                out.add("order_sensitive_aggregate")
        guarded = {id(c) for p in conjuncts(s.where) if isinstance(p, tuple) and p[0] == "cmp" and p[3] in ("<", "<=") for c in calls(p[2])}
        if any(c.name in CLOCK and id(c) not in guarded for c in calls(s)) or any(n[2].lower() in CLOCK for n in columns(s)):
            out.add("output_depends_on_the_clock")
        if s.limit is not None and not s.order:
            out.add("limit_in_a_model")
        nullable = {j.right.alias or j.right.name for j in s.joins if j.kind in ("left", "full")}
        for p in conjuncts(s.where):
            soft = any(isinstance(n, tuple) and n and n[0] in ("is_null", "same", "or") for n in walk(p)) or any(c.name == "coalesce" for c in calls(p))
            if not soft and any(c[1] in nullable for c in columns(p)):
                out.add("left_join_undone_by_where")
        for j in s.joins:
            for p in conjuncts(j.on):
                if isinstance(p, tuple) and p[0] == "cmp" and p[3] == "=":
                    sides = [{c.name for c in calls(side) if c.name in NORMALISERS} for side in p[1:3]]
                    if sides[0] != sides[1]:
                        out.add("join_key_normalised_on_one_side")
        pick = pick_of(s)
        if pick is not None and not pick.over[1]:
            out.add("arbitrary_pick")
        if pick is not None and s.where is not None and s.qualify is not None:
            out.add("window_after_where")
    for n in walk(q):
        if isinstance(n, tuple) and len(n) == 2 and n[0] == "not" and isinstance(n[1], tuple) and n[1][0] == "in_query":
            out.add("not_in_over_a_nullable_subquery")
        if isinstance(n, tuple) and n and n[0] == "full_match" and n[2][0] == "str" and not set(n[2][1]) & set("*+.?["):
            out.add("duckdb_full_match")
        if isinstance(n, tuple) and n and n[0] == "index" and n[2] == ("num", "1"):
            out.add("first_match_pick")
        if isinstance(n, Query) and any(not every for every, _, _ in n.rest):
            out.add("union_distinct")
        if isinstance(n, Select) and len(n.joins) >= 7:
            out.add("too_many_joins")
    return sorted(out)


def is_time(name: str) -> bool:
    """A column named like a time."""
    low = name.lower()
    return low.endswith(("_at", "_ts", "_date", "_time", "_day", "_month")) or low in ("date", "day", "month", "ts", "timestamp")


def digest(text: str) -> dict:
    """All facts of one text; ``reason`` tells why a text could not be read."""
    empty = {"union_members": [], "preaggregated": [], "time_joins": [], "case_values": [], "scalar_wheres": 0, "relations": [], "ctes": [], "outputs": [], "roots": [], "joins": [], "group_keys": [], "unique_kind": None, "unique_on": [], "windows": [], "predicates": [], "shapes": [], "coarse_shapes": [], "patterns": [], "defaults": []}
    try:
        q = parse(text)
    except (Outside, RecursionError) as problem:
        return empty | {"readable": False, "reason": str(problem)}
    selects = [n for n in walk(q) if isinstance(n, Select)]
    ctes = [name for n in walk(q) if isinstance(n, Query) for name, _ in n.ctes]
    last = q.first
    by = unique_by(last) if not q.rest else None
    preds = [p for s in selects for p in conjuncts(s.where)]
    return empty | {
        "readable": True,
        "reason": None,
        "union_members": sorted({r.name for _, _, arm in q.rest for r in walk(arm) if isinstance(r, Relation) and r.name} | ({r.name for r in walk(q.first) if isinstance(r, Relation) and r.name} if q.rest else set())),
        "preaggregated": sorted({r.name for n in walk(q) if isinstance(n, Relation) and n.query is not None and (n.query.first.group or n.query.first.distinct) for r in walk(n.query) if isinstance(r, Relation) and r.name} | {r.name for n in walk(q) if isinstance(n, Query) for _, c in n.ctes if c.first.group or c.first.distinct for r in walk(c) if isinstance(r, Relation) and r.name}),
        "time_joins": sorted({c[2] for s in selects for j in s.joins for c in columns(j.on) if is_time(c[2])}),
        "case_values": sorted({v[1] for n in walk(q) if isinstance(n, tuple) and len(n) == 4 and n[0] == "case" for v in [*(x for _, x in n[2]), n[3]] if v[0] in ("str", "num")}),
        "scalar_wheres": sum(1 for n in walk(q) if isinstance(n, tuple) and n and n[0] == "scalar" and n[1].first.where is not None),
        "relations": sorted({n.name for n in walk(q) if isinstance(n, Relation) and n.name and n.name not in ctes}),
        "ctes": ctes,
        "outputs": [output_name(*i) for i in last.items],
        "roots": [root(e) for e, _ in last.items],
        "joins": [{"kind": j.kind, "relation": j.right.name or j.right.alias or "", "is_equi": (k := equi_keys(j)) is not None, "left_keys": [a for a, _ in k or []], "right_keys": [b for _, b in k or []]} for s in selects for j in s.joins],
        "group_keys": [c[2] for s in selects for g in s.group for c in columns(g)],
        "unique_kind": by and by[0],
        "unique_on": by[1] if by else [],
        "windows": [{"name": c.name, "partition": [p[2] for p in c.over[0] if p[0] == "col"], "order": [k[0][2] for k in c.over[1] if k[0][0] == "col"]} for s in selects for c in calls(s) if c.over is not None],
        "predicates": [c[2] for p in preds for c in columns(p)],
        "shapes": [shape(p) for p in preds],
        "coarse_shapes": [shape(p, True) for p in preds],
        "patterns": patterns(q),
        "defaults": [f"{output_name(e, a)}={e.args[-1][1]}" for e, a in last.items if isinstance(e, Call) and root(e) == "coalesce:literal"],
    }


SCHEMA = (
    "model string, readable boolean, reason string, union_members array<string>, preaggregated array<string>, time_joins array<string>, case_values array<string>, scalar_wheres int, relations array<string>, ctes array<string>, outputs array<string>, roots array<string>, "
    "joins array<struct<kind:string,relation:string,is_equi:boolean,left_keys:array<string>,right_keys:array<string>>>, group_keys array<string>, unique_kind string, unique_on array<string>, "
    "windows array<struct<name:string,partition:array<string>,`order`:array<string>>>, predicates array<string>, shapes array<string>, coarse_shapes array<string>, patterns array<string>, defaults array<string>"
)


def digest_frame(texts: DataFrame) -> DataFrame:
    """(model, sql) -> one row of facts a model; texts are parsed on the executors, in batches."""
    import pandas as pd

    ship_package(texts.sparkSession)
    names = [part.strip().split(" ")[0].strip("`") for part in SCHEMA.replace("array<struct<kind:string,relation:string,is_equi:boolean,left_keys:array<string>,right_keys:array<string>>>", "x").replace("array<struct<name:string,partition:array<string>,`order`:array<string>>>", "x").split(",")]

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame([{"model": m} | digest(s or "") for m, s in zip(pdf["model"], pdf["sql"], strict=True)], columns=names)

    return texts.select("model", "sql").mapInPandas(read, SCHEMA)


def digest_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return digest_frame(spark.createDataFrame(list(texts.items()), "model string, sql string"))
