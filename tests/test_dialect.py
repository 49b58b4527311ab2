"""The dialect: statements drawn from its grammar over generated tables with NULLs, against DuckDB; refusals; digests."""

import random

import duckdb
import pytest

from tallyhouse.plans import compiler, digest
from tallyhouse.plans.syntax import Outside, parse
from tallyhouse.sources.tables import values

#: Column types of the generated tables: parcels are sent from depots and scanned on their way.
SHAPES = {
    "parcels": {"parcel": "bigint", "depot": "bigint", "grams": "bigint", "label": "varchar"},
    "depots": {"depot": "bigint", "city": "varchar", "docks": "bigint"},
    "scans": {"parcel": "bigint", "hour": "bigint", "state": "varchar"},
}
WORDS = ["amber", "birch", "cedar", "a_b", "50%", ""]


def draw_tables(chance, most):
    """Rows with repeated keys, a tenth of each value NULL, and at times an empty table."""

    def value(kind):
        if chance.random() < 0.1:
            return None
        return chance.randint(-4, 9) if kind == "bigint" else chance.choice(WORDS)

    return {name: [tuple(value(kind) for kind in shape.values()) for _ in range(chance.choice([0, 1, *range(6, most)]))] for name, shape in SHAPES.items()}


class Grammar:
    """Draws expressions over the columns (name, type) in scope."""

    def __init__(self, chance, columns):
        self.chance, self.columns = chance, columns

    def of(self, kind):
        return self.chance.choice([c for c, k in self.columns if k == kind])

    def number(self, depth=2):
        pick = self.chance.randint(0, 7) if depth else self.chance.randint(0, 1)
        if pick == 0:
            return str(self.chance.randint(0, 9))
        if pick == 1:
            return self.of("bigint")
        if pick == 2:
            return f"({self.number(depth - 1)} {self.chance.choice('+-*')} {self.number(depth - 1)})"
        if pick == 3:
            return f"coalesce({self.of('bigint')}, {self.number(depth - 1)})"
        if pick == 4:
            return f"nullif({self.number(depth - 1)}, {self.chance.randint(0, 9)})"
        if pick == 5:
            return f"case when {self.truth(depth - 1)} then {self.number(depth - 1)} else {self.number(depth - 1)} end"
        if pick == 6:
            return f"(- {self.of('bigint')})"
        return f"abs({self.number(depth - 1)})"

    def text(self):
        return self.chance.choice([self.of("varchar"), f"{self.of('varchar')} || '-' || {self.of('varchar')}", f"upper({self.of('varchar')})", f"coalesce({self.of('varchar')}, 'none')", "'birch'"])

    def truth(self, depth=2):
        pick = self.chance.randint(0, 8) if depth else self.chance.randint(0, 5)
        no = self.chance.choice(["", "not "])
        if pick == 0:
            return f"{self.of('bigint')} {self.chance.choice(['=', '<>', '<', '<=', '>', '>='])} {self.number(0)}"
        if pick == 1:
            return f"{self.chance.choice([c for c, _ in self.columns])} is {no}null"
        if pick == 2:
            return f"{self.of('bigint')} {no}in ({self.chance.randint(0, 4)}, {self.chance.choice(['null', '7'])}, {self.chance.randint(5, 9)})"
        if pick == 3:
            low = self.chance.randint(-4, 4)
            return f"{self.of('bigint')} {no}between {low} and {low + 4}"
        if pick == 4:
            return f"{self.of('varchar')} {no}like '{self.chance.choice(['%r%', '_i%', 'cedar', '%', ''])}'"
        if pick == 5:
            return f"{self.of('bigint')} is {no}distinct from {self.number(0)}"
        if pick == 6:
            return f"not ({self.truth(depth - 1)})"
        return f"({self.truth(depth - 1)} {self.chance.choice(['and', 'or'])} {self.truth(depth - 1)})"


def scope(*names):
    return [(f"{n[0]}.{c}", kind) for n in names for c, kind in SHAPES[n].items()]


def draw_statement(chance):
    """One statement of a drawn form; every pick has a total order, so that both engines give the same bag."""
    one, both = Grammar(chance, scope("parcels")), Grammar(chance, scope("parcels", "depots"))
    kind = chance.choice(["join", "left join", "right join", "full join"])
    by = chance.choice(["p.depot", "p.label", "p.parcel % 3"])
    every = "p.parcel, p.depot, p.grams, p.label"
    return chance.choice([
        f"select {one.number()} as a, {one.text()} as b, {one.number()} as c from parcels p where {one.truth()}",
        f"select p.parcel as a, d.city as b, {both.number()} as c from parcels p {kind} depots d on p.depot = d.depot where {both.truth()}",
        f"select depot, city, grams from parcels {kind} depots using (depot)",
        f"select d.city as a, s.state as b, count(*) as n from parcels p join depots d on p.depot = d.depot left join scans s on s.parcel = p.parcel and s.hour > {chance.randint(0, 6)} group by d.city, s.state",
        f"select {by} as a, count(*) as n, count(p.grams) as c, count(distinct p.label) as u, sum({one.number(1)}) as s, min(p.grams) as lo, max(p.label) as hi from parcels p where {one.truth()} group by {by}",
        f"select {by} as a, count(*) filter (where {one.truth()}) as n, sum(p.grams) - count(*) as s from parcels p group by {by} having count(*) > {chance.randint(0, 3)}",
        f"select count(*) as n, sum(p.grams) as s, max(p.label) as m from parcels p where {one.truth()}",
        f"select distinct {one.number(1)} as a, p.label as b from parcels p",
        f"select distinct {every} from parcels p qualify row_number() over (partition by {by} order by p.grams {chance.choice(['', 'desc'])}, p.parcel, p.depot, p.label) <= {chance.randint(1, 2)} and {one.truth(1)}",
        "select distinct on (p.depot) p.depot as a, p.grams as b, p.label as c, p.parcel as d from parcels p order by p.depot, p.grams desc, p.label, p.parcel",
        f"select p.depot as a from parcels p where {one.truth()} {chance.choice(['union', 'union all'])} select d.depot from depots d",
        "select parcel, label from parcels union all by name select state as label, hour, parcel from scans",
        f"select p.parcel as a from parcels p where p.depot {chance.choice(['', 'not '])}in (select d.depot from depots d where d.docks > {chance.randint(0, 5)})",
        f"select p.parcel as a, p.label as b from parcels p where {chance.choice(['', 'not '])}exists (select 1 from scans s where s.parcel = p.parcel and s.hour < {chance.randint(2, 8)})",
        f"with heavy as (select p.depot as depot, sum(p.grams) as total from parcels p where {one.truth()} group by p.depot) select d.city as a, h.total as b from depots d left join heavy h on h.depot = d.depot",
        f"select q.a as a, q.b as b from (select p.depot as a, {one.number()} as b from parcels p) q where q.b > {chance.randint(-3, 6)}",
        f"select s.parcel as a, s.hour as b, {chance.choice(['lag', 'lead'])}(s.hour) over (partition by s.parcel order by s.hour, s.state) as c, dense_rank() over (partition by s.parcel order by s.hour) as r from scans s",
    ])


def duck_rows(text, tables):
    connection = duckdb.connect()
    for name, rows in tables.items():
        connection.execute(f"create table {name} ({', '.join(f'{c} {kind}' for c, kind in SHAPES[name].items())})")
        if rows:
            connection.executemany(f"insert into {name} values ({', '.join('?' * len(SHAPES[name]))})", rows)
    found = connection.sql(text)
    return found.columns, sorted(map(repr, found.fetchall()))


@pytest.mark.parametrize("seed", range(10))
def test_drawn_statements(spark, seed):
    chance = random.Random(seed)
    tables = draw_tables(chance, 40)
    frames = {name: spark.createDataFrame(rows, ", ".join(f"{c} {kind.replace('varchar', 'string')}" for c, kind in SHAPES[name].items())).coalesce(1) for name, rows in tables.items()}
    for _ in range(12):
        text = draw_statement(chance)
        columns, rows = duck_rows(text, tables)
        found = compiler.run(spark, text, frames)
        assert found.columns == columns, text
        assert sorted(repr(tuple(r)) for r in found.collect()) == rows, (text, tables)


def test_whole_number_division(spark):
    frames = {"odd": values(spark, [(13,)], ["n"])}
    rows = compiler.run(spark, "select n / 2 as q, -n / 2 as n, n % 0 as z from odd", frames).collect()
    assert [tuple(r) for r in rows] == [(6, -6, None)]


@pytest.mark.parametrize("text", ["select 1 from a semi join b on a.k = b.k", "select k from a group by all", "select * replace (1 as k) from a", "select 1 except select 2", "select sum(v) over (order by k rows 1 preceding) from a", "select from", "select '", "with recursive x as (select 1) select 1"])
def test_refused(text):
    with pytest.raises(Outside):
        parse(text)


def test_unknown_relation(spark):
    with pytest.raises(KeyError):
        compiler.run(spark, "select 1 as x from nowhere", {})


def test_digest_facts():
    told = digest.digest("with o as (select * from raw.orders) select c.id, sum(o.x) as total, coalesce(c.y, 0) as y, 'a' as w from customers c left join o on lower(c.id) = o.cid where o.x > 1 group by 1")
    assert told["relations"] == ["customers", "orders"] and told["ctes"] == ["o"]
    assert told["roots"] == ["column", "agg:sum", "coalesce:literal", "literal"]
    assert told["unique_kind"] == "group_by" and told["unique_on"] == ["id"]
    assert set(told["patterns"]) == {"join_key_normalised_on_one_side", "left_join_undone_by_where"}
    assert not told["joins"][0]["is_equi"]
    pick = digest.digest("select id from (select id, row_number() over (partition by id order by at desc) as rn from x) where rn = 1")
    assert pick["unique_kind"] == "qualify_dedupe" and pick["unique_on"] == ["id"]
    broken = digest.digest("select a from b lateral view c")
    assert not broken["readable"] and broken["reason"]
    assert [digest.provenance(k) for k in ("literal", "null", "coalesce:literal", "window:rank", "agg:sum", "column", "case")] == ["constant", "null_placeholder", "defaulted", "ranked", "aggregated", "carried", "computed"]


def test_digest_of_unions_cases_and_times():
    told = digest.digest("select case when a = 1 then 'x' else 'y' end as c from t join (select k, max(v) as v from u group by k) g on t.k = g.k and t.day = g.day where v > (select avg(v) from w where k = 1) union all select c from z")
    assert told["union_members"] == ["t", "u", "w", "z"] and told["preaggregated"] == ["u"]
    assert told["time_joins"] == ["day"] and told["case_values"] == ["x", "y"] and told["scalar_wheres"] == 1
