"""Lexer and parser of the dialect.

A tree is made of plain tuples and dataclasses. What lies outside of the dialect raises ``Outside`` with a
reason, so that a text that cannot be read is reported and never passes as empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Outside(ValueError):
    """The text uses something that the dialect does not define."""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<number>\d+\.\d*|\.\d+|\d+)"""
    r"""|(?P<word>[A-Za-z_][\w$]*)|(?P<op><=|>=|<>|!=|\|\||::|->|[-+*/%=<>(),.\[\]~;])""",
    re.S,
)
#: Words that end an expression or a relation, and so are never taken as an alias.
RESERVED = frozenset(
    "select from where group having order limit offset qualify union except intersect on using join inner left right full cross outer as and or not in is like ilike between case when then else end by all distinct with exists filter over partition asc desc nulls lateral natural window values semi anti asof positional tablesample".split()
)
#: Other names of types and functions.
TYPES = {"int4": "int", "integer": "int", "int8": "bigint", "float8": "double", "float4": "float", "real": "float", "numeric": "decimal", "text": "string", "varchar": "string", "char": "string", "datetime": "timestamp", "bool": "boolean"}
FUNCTIONS = {"ifnull": "coalesce", "nvl": "coalesce", "substr": "substring", "len": "length", "lcase": "lower", "ucase": "upper", "pow": "power", "ceiling": "ceil", "string_split": "split", "array_agg": "collect_list", "list": "collect_list", "group_concat": "listagg", "string_agg": "listagg", "list_contains": "array_contains"}
AGGREGATES = frozenset("count sum min max avg stddev variance collect_list listagg any_value first last bool_and bool_or stddev_samp var_samp".split())
ORDER_SENSITIVE = frozenset("collect_list listagg any_value first last".split())


@dataclass
class Call:
    name: str
    args: list
    distinct: bool = False
    star: bool = False
    condition: object = None
    order: list = field(default_factory=list)
    over: tuple | None = None  # (partition, order)
    ignore_nulls: bool = False


@dataclass
class Relation:
    name: str | None
    query: object = None
    alias: str | None = None


@dataclass
class Join:
    kind: str
    right: Relation
    on: object = None
    using: list | None = None


@dataclass
class Select:
    items: list  # (expression, alias); a star is ("star", qualifier, excluded)
    source: Relation | None
    joins: list
    where: object = None
    group: list = field(default_factory=list)
    having: object = None
    qualify: object = None
    distinct: bool = False
    distinct_on: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None


@dataclass
class Query:
    ctes: list  # (name, Query)
    first: Select
    rest: list  # (all, by_name, Select)
    order: list = field(default_factory=list)
    limit: int | None = None


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Outside(f"a character at {at}: {text[at]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    # -- tokens
    def word(self, k: int = 0) -> str:
        kind, text = self.toks[min(self.at + k, len(self.toks) - 1)]
        return text.lower() if kind in ("word", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Outside(f"expected {' '.join(words)} at {self.toks[self.at][1]!r}")

    def name(self) -> str:
        kind, text = self.toks[self.at]
        if kind == "quoted":
            self.at += 1
            return text[1:-1].replace('""', '"')
        if kind != "word":
            raise Outside(f"expected a name at {text!r}")
        self.at += 1
        return text

    def many(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # -- queries
    def parse(self) -> Query:
        query = self.query()
        self.take(";")
        if self.toks[self.at][0] != "end":
            raise Outside(f"text behind the query: {self.toks[self.at][1]!r}")
        return query

    def query(self) -> Query:
        ctes = []
        if self.take("with"):
            if self.word() == "recursive":
                raise Outside("a recursive query")
            ctes = self.many(self.cte)
        first, rest = self.select(), []
        while self.word() in ("union", "except", "intersect"):
            if not self.take("union"):
                raise Outside(self.word())
            every = self.take("all")
            rest.append((every, self.take("by", "name"), self.select()))
        query = Query(ctes, first, rest)
        if self.take("order", "by"):
            query.order = self.many(self.order_key)
        if self.take("limit"):
            query.limit = self.number()
        if self.word() == "offset":
            raise Outside("offset")
        if not rest:
            first.order, first.limit = query.order, query.limit
            if not first.distinct_on:
                pass
            query.order, query.limit = [], None
        return query

    def cte(self) -> tuple[str, Query]:
        name = self.name()
        self.need("as", "(")
        query = self.query()
        self.need(")")
        return name, query

    def number(self) -> int:
        kind, text = self.toks[self.at]
        if kind != "number" or not text.isdigit():
            raise Outside("a limit that is not a number")
        self.at += 1
        return int(text)

    def select(self) -> Select:
        if self.take("("):
            inner = self.query()
            self.need(")")
            return Select([(("star", None, []), None)], Relation(None, inner, "q"), [])
        self.need("select")
        distinct, on = False, []
        if self.take("distinct"):
            distinct = True
            if self.take("on"):
                self.need("(")
                on, distinct = self.many(self.expression), False
                self.need(")")
        out = Select(self.many(self.item), None, [], distinct=distinct, distinct_on=on)
        if self.take("from"):
            out.source = self.relation()
            while (join := self.join()) is not None:
                out.joins.append(join)
        if self.take("where"):
            out.where = self.expression()
        if self.take("group", "by"):
            if self.word() in ("all", "rollup", "cube", "grouping"):
                raise Outside(f"group by {self.word()}")
            out.group = self.many(self.expression)
        if self.take("having"):
            out.having = self.expression()
        if self.take("qualify"):
            out.qualify = self.expression()
        return out

    def item(self):
        qualifier = None
        if self.word(1) == "." and self.word(2) == "*":
            qualifier = self.name()
            self.need(".")
        if self.take("*"):
            excluded = []
            if self.word() in ("exclude", "except") and self.word(1) == "(":
                self.at += 2
                excluded = self.many(self.name)
                self.need(")")
            if self.word() in ("replace", "rename"):
                raise Outside(f"* {self.word()}")
            return ("star", qualifier, excluded), None
        expression = self.expression()
        return expression, self.alias()

    def alias(self) -> str | None:
        if self.take("as"):
            return self.name()
        kind, text = self.toks[self.at]
        return self.name() if kind == "quoted" or kind == "word" and text.lower() not in RESERVED else None

    def relation(self) -> Relation:
        if self.word() == "lateral":
            raise Outside("lateral")
        if self.take("("):
            query = self.query()
            self.need(")")
            return Relation(None, query, self.alias())
        name = self.name()
        while self.take("."):
            name = self.name()  # the last part names the relation
        return Relation(name, None, self.alias())

    def join(self) -> Join | None:
        if self.take(","):
            return Join("cross", self.relation())
        for kind in ("inner", "left", "right", "full", "cross"):
            if self.word() == kind:
                self.at += 1
                self.take("outer")
                if self.word() in ("semi", "anti"):
                    raise Outside(f"{self.word()} join")
                self.need("join")
                break
        else:
            if self.word() in ("semi", "anti", "asof", "positional", "natural"):
                raise Outside(f"{self.word()} join")
            if not self.take("join"):
                return None
            kind = "inner"
        out = Join(kind, self.relation())
        if self.take("on"):
            out.on = self.expression()
        elif self.take("using"):
            self.need("(")
            out.using = self.many(self.name)
            self.need(")")
        elif kind != "cross":
            out.kind = "cross"
        return out

    def order_key(self) -> tuple:
        expression = self.expression()
        desc = self.take("desc")
        if not desc:
            self.take("asc")
        nulls_first = False  # NULLs come last, whatever the direction
        if self.take("nulls", "first"):
            nulls_first = True
        else:
            self.take("nulls", "last")
        return expression, desc, nulls_first

    # -- expressions, by binding strength
    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = ("and", left, self.negation())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.predicate()

    def predicate(self):
        left = self.sum()
        while True:
            if self.take("is"):
                negated = self.take("not")
                if self.take("null"):
                    left = ("is_null", left)
                elif self.take("distinct", "from"):
                    left = ("not", ("same", left, self.sum()))
                elif self.word() in ("true", "false"):
                    left = ("same", left, ("bool", self.word() == "true"))
                    self.at += 1
                else:
                    raise Outside("is")
                if negated:
                    left = left[1] if left[0] == "not" else ("not", left)
                continue
            negated = self.word() == "not" and self.word(1) in ("in", "like", "ilike", "between")
            if negated:
                self.at += 1
            if self.take("in"):
                self.need("(")
                if self.word() in ("select", "with"):
                    left = ("in_query", left, self.query())
                else:
                    left = ("in", left, self.many(self.expression))
                self.need(")")
            elif self.word() in ("like", "ilike"):
                kind = self.word()
                self.at += 1
                left = (kind, left, self.sum())
            elif self.take("between"):
                low = self.sum()
                self.need("and")
                left = ("between", left, low, self.sum())
            elif self.word() in ("=", "<>", "!=", "<", "<=", ">", ">=", "~"):
                op = self.word()
                self.at += 1
                left = ("full_match" if op == "~" else "cmp", left, self.sum(), "<>" if op == "!=" else op)
            else:
                return left
            if negated:
                left = ("not", left)

    def sum(self):
        left = self.product()
        while self.word() in ("+", "-", "||"):
            op = self.word()
            self.at += 1
            left = ("math", left, self.product(), op)
        return left

    def product(self):
        left = self.unary()
        while self.word() in ("*", "/", "%"):
            op = self.word()
            self.at += 1
            left = ("math", left, self.unary(), op)
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        out = self.primary()
        while True:
            if self.take("::"):
                out = ("cast", out, self.type_name(), False)
            elif self.take("["):
                out = ("index", out, self.expression())
                self.need("]")
            else:
                return out

    def type_name(self) -> str:
        base = TYPES.get(self.name().lower(), self.toks[self.at - 1][1].lower())
        if self.take("("):
            sizes = [str(self.number())]
            while self.take(","):
                sizes.append(str(self.number()))
            self.need(")")
            return base if base == "string" else f"{base}({','.join(sizes)})"
        return base

    def primary(self):
        kind, text = self.toks[self.at]
        low = text.lower()
        if kind == "number":
            self.at += 1
            return ("num", text)
        if kind == "string":
            self.at += 1
            return ("str", text[1:-1].replace("''", "'"))
        if low in ("date", "timestamp") and self.toks[self.at + 1][0] == "string":
            self.at += 2
            return ("typed", low, self.toks[self.at - 1][1][1:-1])
        if low == "interval" and self.toks[self.at + 1][0] in ("string", "number"):
            self.at += 2
            return ("interval", self.toks[self.at - 1][1].strip("'"), self.name().lower())
        if self.take("null"):
            return ("null",)
        if low in ("true", "false") and kind == "word":
            self.at += 1
            return ("bool", low == "true")
        if self.take("case"):
            operand = None if self.word() == "when" else self.expression()
            branches, otherwise = [], ("null",)
            while self.take("when"):
                condition = self.expression()
                self.need("then")
                branches.append((condition, self.expression()))
            if self.take("else"):
                otherwise = self.expression()
            self.need("end")
            return ("case", operand, branches, otherwise)
        if low in ("cast", "try_cast") and self.word(1) == "(":
            self.at += 2
            value = self.expression()
            self.need("as")
            kind_name = self.type_name()
            self.need(")")
            return ("cast", value, kind_name, low == "try_cast")
        if low == "exists" and self.word(1) == "(":
            self.at += 2
            query = self.query()
            self.need(")")
            return ("exists", query)
        if low == "extract" and self.word(1) == "(":
            self.at += 2
            part = self.name().lower()
            self.need("from")
            value = self.expression()
            self.need(")")
            return Call("date_part", [("str", part), value])
        if self.take("["):
            items = [] if self.word() == "]" else self.many(self.expression)
            self.need("]")
            return ("list", items)
        if self.take("("):
            if self.word() in ("select", "with"):
                query = self.query()
                self.need(")")
                return ("scalar", query)
            items = self.many(self.expression)
            self.need(")")
            return items[0] if len(items) == 1 else ("tuple", items)
        if kind in ("word", "quoted") and (kind == "quoted" or low not in RESERVED):
            name = self.name()
            if kind == "word" and self.take("("):
                return self.call(name)
            if kind == "word" and self.take("->"):
                return ("lambda", name, self.expression())
            parts = [name]
            while self.take("."):
                parts.append(self.name())
            return ("col", parts[-2] if len(parts) > 1 else None, parts[-1])
        raise Outside(f"an expression at {text!r}")

    def call(self, name: str) -> Call:
        out = Call(FUNCTIONS.get(name.lower(), name.lower()), [])
        if self.take("*"):
            out.star = True
        elif self.word() != ")":
            out.distinct = self.take("distinct")
            out.args = self.many(self.expression)
            if self.take("order", "by"):
                out.order = self.many(self.order_key)
            if self.take("ignore", "nulls"):
                out.ignore_nulls = True
        self.need(")")
        if self.take("ignore", "nulls"):
            out.ignore_nulls = True
        if self.word() == "within":
            raise Outside("within group")
        if self.take("filter", "(", "where"):
            out.condition = self.expression()
            self.need(")")
        if self.take("over"):
            self.need("(")
            partition = self.many(self.expression) if self.take("partition", "by") else []
            order = self.many(self.order_key) if self.take("order", "by") else []
            if self.word() in ("rows", "range", "groups"):
                raise Outside("a window frame")
            self.need(")")
            out.over = (partition, order)
        return out


def parse(text: str) -> Query:
    return Parser(text).parse()
