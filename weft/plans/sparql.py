"""A graph-query front end: SPARQL text to a DataFrame plan, which Catalyst then optimises.

A solution is a row with one string column per variable, holding a term in its
written form: ``<iri>``, ``_:node``, ``"text"`` or ``"text"^^<type>``; null is
unbound. Each pattern is one filtered scan of the triples and shared variables
become equi-joins. Variables that may be unbound on either side join to
everything, as the standard asks; the plain equality is used wherever both
sides bind them for certain.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.graph import ONTOLOGY, RDF_TYPE, XSD
from weft.plans.storage import materialize

PREFIXES = {"ch": ONTOLOGY, "kb": ONTOLOGY, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": XSD, "ql": "ql:"}
CONTAINS_WORD, CONTAINS_ENTITY = "ql:contains-word", "ql:contains-entity"

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>\s"{}|^`\\]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z-]+)
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<node>_:\w+)
    |(?P<name>[A-Za-z_][\w-]*)?:(?P<local>[A-Za-z_0-9][\w.\-]*[\w\-]|[A-Za-z_0-9])?
    |(?P<word>[A-Za-z_]\w*)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,*/+\-|^?=<>!\[\]])""",
    re.X,
)


class SparqlError(ValueError):
    """The text is no query that this front end understands."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SparqlError(f"cannot read {text[at : at + 20]!r}")
        if m.lastgroup:
            kind = "pname" if m.lastgroup in ("name", "local") else m.lastgroup
            out.append((kind, m[0]))
        elif m[0] == ":":
            out.append(("pname", ":"))
        at = m.end()
    return out


def literal(text: str, datatype: str | None = None) -> str:
    said = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{said}"' if datatype in (None, XSD + "string") else f'"{said}"^^<{datatype}>'


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "'": "'", "\\": "\\"}


def _unquote(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), text[1:-1])


# --- terms in columns ------------------------------------------------------------------------------------------------


def term_of(text: Column, kind: Column, datatype: Column) -> Column:
    quoted = text
    for raw, said in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(said))
    plain = F.concat(F.lit('"'), quoted, F.lit('"'))
    return (
        F.when(kind == "iri", F.concat(F.lit("<"), text, F.lit(">"))).when(kind == "bnode", text)
        .when(datatype.isNull() | (datatype == XSD + "string"), plain).otherwise(F.concat(plain, F.lit("^^<"), datatype, F.lit(">")))
    )


def lexical(term: Column) -> Column:
    """The value that a term stands for, as text."""
    inside = F.regexp_extract(term, r'(?s)^"(.*)"(?:\^\^<[^>]*>|@[A-Za-z-]+)?$', 1)
    for said, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        inside = F.replace(inside, F.lit(said), F.lit(raw))
    return F.when(term.startswith('"'), inside).when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).otherwise(term)


def _number(text: Column) -> Column:
    return text.try_cast("double")


@dataclass
class Value:
    """An expression: a term, a number, a string or a truth value."""

    col: Column
    kind: str

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "num":
            whole = self.col == F.floor(self.col)
            text = F.when(whole, self.col.cast("long").cast("string")).otherwise(self.col.cast("string"))
            return F.concat(F.lit('"'), text, F.when(whole, F.lit(f'"^^<{XSD}integer>')).otherwise(F.lit(f'"^^<{XSD}decimal>')))
        if self.kind == "bool":
            return F.concat(F.lit('"'), self.col.cast("string"), F.lit(f'"^^<{XSD}boolean>'))
        return term_of(self.col, F.lit("literal"), F.lit(None).cast("string"))

    def text(self) -> Column:
        return lexical(self.col) if self.kind == "term" else self.col.cast("string")

    def num(self) -> Column:
        return self.col.cast("double") if self.kind == "num" else _number(self.text())

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return self.col != 0
        text = self.text()
        return F.coalesce(_number(text) != 0, (text != "") & (F.lower(text) != "false"))


# --- syntax ----------------------------------------------------------------------------------------------------------


@dataclass
class Group:
    """Elements of a group in order: (kind, what)."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str = "select"
    distinct: bool = False
    star: bool = False
    items: list[tuple] = field(default_factory=list)  # (name, expression or None)
    template: list[tuple] = field(default_factory=list)
    where: Group = field(default_factory=Group)
    group_by: list[tuple] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order_by: list[tuple] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Parser:
    def __init__(self, text: str):
        self.toks, self.at, self.prefixes, self.fresh, self.base = _tokens(text), 0, dict(PREFIXES), 0, ""

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.toks[self.at + ahead] if self.at + ahead < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        tok = self.peek()
        self.at += 1
        return tok

    def is_word(self, *names: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in names

    def word(self, *names: str) -> bool:
        if self.is_word(*names):
            self.at += 1
            return True
        return False

    def op(self, *signs: str) -> str:
        kind, text = self.peek()
        if kind == "op" and text in signs:
            self.at += 1
            return text
        return ""

    def need(self, sign: str) -> None:
        if not self.op(sign):
            raise SparqlError(f"{sign!r} expected, not {self.peek()[1]!r}")

    def need_word(self, name: str) -> None:
        if not self.word(name):
            raise SparqlError(f"{name} expected, not {self.peek()[1]!r}")

    def new_var(self) -> str:
        self.fresh += 1
        return f"_v{self.fresh}"

    # -- queries

    def query(self) -> Query:
        self.prologue()
        q = self.form()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return q

    def prologue(self) -> None:
        while self.is_word("PREFIX", "BASE"):
            if self.word("BASE"):
                self.base = self.iri(self.next()[1])[1:-1]
                continue
            self.word("PREFIX")
            name = self.next()[1]
            self.prefixes[name[:-1]] = self.iri(self.next()[1])[1:-1]

    def iri(self, text: str) -> str:
        """A written IRI; a relative one is resolved against BASE, and stays as it is without one."""
        name = text[1:-1]
        if not self.base or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", name):
            return text
        scheme, rest = self.base.split(":", 1)
        return f"<{scheme}:{urljoin('http:' + rest, name)[5:]}>"  # the rules are those of http for any scheme

    def form(self) -> Query:
        q = Query()
        if self.word("SELECT"):
            self.select(q)
        elif self.word("ASK"):
            q.form = "ask"
        elif self.word("CONSTRUCT"):
            q.form = "construct"
            q.template = self.template()
        elif self.word("DESCRIBE"):
            q.form = "describe"
            while self.peek()[0] in ("var", "iri", "pname"):
                q.template.append(self.node())
            if self.op("*"):
                q.star = True
            if not q.template and not q.star:
                raise SparqlError("DESCRIBE names nothing")
            if not self.is_word("WHERE") and self.peek() != ("op", "{"):
                return q
        elif self.word("INSERT", "DELETE"):
            q.form = self.peek(-1)[1].lower()
            if self.word("DATA"):
                q.template = self.template()
                return q
            if q.form == "delete" and self.is_word("WHERE"):
                self.word("WHERE")
                start = self.at
                q.template = self.template()
                self.at = start
                q.where = self.group()
                return q
            q.template = self.template()
            self.need_word("WHERE")
            q.where = self.group()
            return q
        else:
            raise SparqlError(f"a query cannot begin with {self.peek()[1]!r}")
        self.word("WHERE")
        q.where = self.group()
        self.modifiers(q)
        return q

    def select(self, q: Query) -> None:
        if self.word("DISTINCT", "REDUCED"):
            q.distinct = True
        if self.op("*"):
            q.star = True
            return
        while True:
            if self.peek()[0] == "var":
                q.items.append((self.next()[1][1:], None))
            elif self.op("("):
                e = self.expression()
                self.need_word("AS")
                q.items.append((self.next()[1][1:], e))
                self.need(")")
            else:
                break
        if not q.items:
            raise SparqlError("SELECT names nothing")

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            while self.peek()[0] == "var" or self.peek() == ("op", "("):
                if self.op("("):
                    e = self.expression()
                    name = self.new_var()
                    if self.word("AS"):
                        name = self.next()[1][1:]
                    self.need(")")
                    q.group_by.append((name, e))
                else:
                    q.group_by.append((self.next()[1][1:], None))
        if self.word("HAVING"):
            while self.op("("):
                q.having.append(self.expression())
                self.need(")")
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                if self.word("ASC", "DESC"):
                    down = self.peek(-1)[1].upper() == "DESC"
                    self.need("(")
                    q.order_by.append((self.expression(), down))
                    self.need(")")
                elif self.peek()[0] == "var":
                    q.order_by.append((("var", self.next()[1][1:]), False))
                elif self.op("("):
                    q.order_by.append((self.expression(), False))
                    self.need(")")
                else:
                    break
        while self.is_word("LIMIT", "OFFSET"):
            if self.word("LIMIT"):
                q.limit = int(self.next()[1])
            elif self.word("OFFSET"):
                q.offset = int(self.next()[1])

    # -- patterns

    def template(self) -> list[tuple]:
        self.need("{")
        out: list[tuple] = []
        while not self.op("}"):
            self.triples(out)
            self.op(".")
        return out

    def group(self) -> Group:
        self.need("{")
        g = Group()
        if self.is_word("SELECT"):
            g.parts.append(("select", self.form()))
            self.need("}")
            return g
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("FILTER"):
                if self.is_word("NOT") or self.is_word("EXISTS"):
                    negative = self.word("NOT")
                    self.need_word("EXISTS")
                    g.parts.append(("exists", self.group(), not negative))
                else:
                    g.parts.append(("filter", self.primary() if self.peek() != ("op", "(") else self.bracketed()))
            elif self.word("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need_word("AS")
                g.parts.append(("bind", self.next()[1][1:], e))
                self.need(")")
            elif self.word("VALUES"):
                g.parts.append(self.values())
            elif self.peek() == ("op", "{"):
                arms = [self.group()]
                while self.word("UNION"):
                    arms.append(self.group())
                g.parts.append(("union", arms))
            else:
                found: list[tuple] = []
                self.triples(found)
                g.parts.extend(("triple", *t) for t in found)
        return g

    def values(self) -> tuple:
        names, rows = [], []
        if self.op("("):
            while not self.op(")"):
                names.append(self.next()[1][1:])
            self.need("{")
            while not self.op("}"):
                self.need("(")
                row = []
                while not self.op(")"):
                    row.append(None if self.word("UNDEF") else self.node()[1])
                rows.append(row)
        else:
            names.append(self.next()[1][1:])
            self.need("{")
            while not self.op("}"):
                rows.append([None if self.word("UNDEF") else self.node()[1]])
        return "values", names, rows

    def triples(self, out: list[tuple]) -> None:
        s = self.node()
        while True:
            p = self.path()
            while True:
                out.append((s, p, self.node()))
                if not self.op(","):
                    break
            again = False
            while self.op(";"):
                again = True
            if not again or self.peek() in (("op", "."), ("op", "}")) or self.peek()[0] == "end":
                return

    def node(self) -> tuple[str, str]:
        """('var', name) or ('term', written form)."""
        kind, text = self.next()
        if kind == "var":
            return "var", text[1:]
        if kind == "iri":
            return "term", self.iri(text)
        if kind == "pname":
            return "term", f"<{self.expand(text)}>"
        if kind == "node":
            return "term", text
        if kind == "str":
            value, datatype = _unquote(text), None
            if self.op("^^"):
                datatype = self.node()[1][1:-1]
            elif self.peek()[0] == "lang":
                return "term", literal(value) + self.next()[1]
            return "term", literal(value, datatype)
        if kind == "num" or (kind == "op" and text == "-" and self.peek()[0] == "num"):
            sign = ""
            if kind == "op":
                sign, (_, text) = "-", self.next()
            return "term", literal(sign + text, XSD + ("decimal" if "." in text else "double" if "e" in text.lower() else "integer"))
        if kind == "word" and text in ("true", "false"):
            return "term", literal(text, XSD + "boolean")
        if kind == "word" and text == "a":
            return "term", f"<{RDF_TYPE}>"
        raise SparqlError(f"a term expected, not {text!r}")

    def expand(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise SparqlError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + local

    # -- property paths: ('iri', x), ('inv', p), ('seq', a, b), ('alt', a, b), ('more', p), ('any', p), ('opt', p), ('var', name)

    def path(self) -> tuple:
        left = self.path_sequence()
        while self.op("|"):
            left = ("alt", left, self.path_sequence())
        return left

    def path_sequence(self) -> tuple:
        left = self.path_step()
        while self.op("/"):
            left = ("seq", left, self.path_step())
        return left

    def path_step(self) -> tuple:
        if self.op("^"):
            return "inv", self.path_step()
        if self.op("("):
            inner = self.path()
            self.need(")")
        else:
            kind, text = self.node()
            inner = ("var", text) if kind == "var" else ("iri", text)
        if inner[0] != "var":
            sign = self.op("+", "*", "?")
            if sign:
                return {"+": "more", "*": "any", "?": "opt"}[sign], inner
        return inner

    # -- expressions, as tuples

    def bracketed(self) -> tuple:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.op("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.op("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        sign = self.op("=", "!=", "<", "<=", ">", ">=")
        if sign:
            return "cmp", sign, left, self.sum()
        negative = self.is_word("NOT") and self.peek(1)[1].upper() == "IN"
        if negative:
            self.next()
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.expression())
                self.op(",")
            e = ("in", left, items)
            return ("not", e) if negative else e
        return left

    def sum(self) -> tuple:
        left = self.product()
        while sign := self.op("+", "-"):
            left = ("calc", sign, left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while sign := self.op("*", "/"):
            left = ("calc", sign, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.op("!"):
            return "not", self.unary()
        if self.op("-"):
            return "calc", "-", ("term", literal("0", XSD + "integer")), self.unary()
        return self.primary()

    def primary(self) -> tuple:
        if self.peek() == ("op", "("):
            return self.bracketed()
        if self.is_word("NOT", "EXISTS"):
            negative = self.word("NOT")
            self.need_word("EXISTS")
            return "exists", self.group(), not negative
        kind, text = self.peek()
        called = self.peek(1) == ("op", "(")
        if kind == "word" and called and text.upper() in AGGREGATES:
            return self.aggregate()
        if kind in ("word", "pname") and called:
            self.next()
            name = text.upper() if kind == "word" else "CAST:" + self.expand(text)
            self.need("(")
            args = []
            while not self.op(")"):
                args.append(self.expression())
                self.op(",")
            return "call", name, args
        return self.node()

    def aggregate(self) -> tuple:
        name = self.next()[1].upper()
        self.need("(")
        distinct, between = self.word("DISTINCT"), " "
        inner = None if self.op("*") else self.expression()
        if self.op(";"):
            self.need_word("SEPARATOR")
            self.need("=")
            between = _unquote(self.next()[1])
        self.need(")")
        return "agg", name, distinct, inner, between


def parse(text: str) -> Query:
    return Parser(text).query()


# --- plans -----------------------------------------------------------------------------------------------------------


@dataclass
class Solutions:
    """df has a column for every variable of ``sure`` (bound in every row) and ``maybe``."""

    df: DataFrame
    sure: set[str]
    maybe: set[str] = field(default_factory=set)

    @property
    def names(self) -> set[str]:
        return self.sure | self.maybe


class Compiler:
    """triples: s, p, o, o_kind, o_datatype. keyword: (word, is it a beginning) -> chunk term, text term, score."""

    def __init__(self, triples: DataFrame, keyword: Callable[[str, bool], DataFrame] | None = None):
        self.triples, self.keyword, self.spark = triples, keyword, triples.sparkSession

    # -- joins

    def join(self, a: Solutions, b: Solutions, how: str = "inner", extra: Column | None = None) -> Solutions:
        shared = sorted(a.names & b.names)
        plain = all(v in a.sure and v in b.sure for v in shared)
        if plain and extra is None and shared:
            df = a.df.join(b.df, shared, how)
        else:
            right = b.df.select(*[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in b.df.columns])
            on = F.lit(True)
            for v in shared:
                same = F.col(v) == F.col(f"_r_{v}")
                if v not in a.sure or v not in b.sure:
                    same = same | F.col(v).isNull() | F.col(f"_r_{v}").isNull()
                on = on & same
            if extra is not None:
                on = on & extra
            df = a.df.join(right, on, how)
            if how in ("inner", "left"):
                df = df.select(*[F.coalesce(v, f"_r_{v}").alias(v) if v in shared else F.col(v) for v in [*a.df.columns, *(c for c in b.df.columns if c not in shared)]])
        if how in ("left_semi", "left_anti"):
            return Solutions(df, a.sure, a.maybe)
        sure = a.sure | b.sure if how == "inner" else set(a.sure)
        return Solutions(df, sure, (a.names | b.names) - sure)

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(F.lit(1).alias("_unit")), set())

    def meet(self, a: Solutions | None, b: Solutions) -> Solutions:
        return b if a is None else self.join(a, b)

    # -- patterns

    def scan(self, s: tuple, p: tuple, o: tuple) -> Solutions:
        df = self.triples
        for node, column in ((s, "s"), (p, "p")):
            if node[0] == "term":
                value = node[1][1:-1] if node[1].startswith("<") else node[1]
                df = df.where(F.col(column) == value)
        if o[0] == "term":
            df = df.where(self._object_is(o[1]))
        subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))
        columns: dict[str, Column] = {}
        for node, col in ((s, subject), (p, F.concat(F.lit("<"), F.col("p"), F.lit(">"))), (o, term_of(F.col("o"), F.col("o_kind"), F.col("o_datatype")))):
            if node[0] == "var":
                if node[1] in columns:
                    df = df.where(columns[node[1]] == col)
                columns[node[1]] = col
        df = df.select(*[c.alias(v) for v, c in columns.items()]) if columns else df.select(F.lit(1).alias("_hit")).limit(1)
        return Solutions(df, set(columns))

    def _object_is(self, term: str) -> Column:
        if term.startswith("<"):
            return (F.col("o_kind") == "iri") & (F.col("o") == term[1:-1])
        if term.startswith("_:"):
            return (F.col("o_kind") == "bnode") & (F.col("o") == term)
        m = re.fullmatch(r'(?s)("(?:[^"\\]|\\.)*")(?:\^\^<([^>]*)>|@[\w-]+)?', term)
        value = _unquote(m[1])
        kind = m[2] or XSD + "string"
        if kind in (XSD + "integer", XSD + "decimal", XSD + "double"):
            numeric = F.col("o_datatype").isin(XSD + "integer", XSD + "decimal", XSD + "double")
            return (F.col("o_kind") == "literal") & numeric & (_number(F.col("o")) == float(value))
        return (F.col("o_kind") == "literal") & (F.coalesce("o_datatype", F.lit(XSD + "string")) == kind) & (F.col("o") == value)

    def path_pairs(self, p: tuple) -> DataFrame:
        """Distinct _a, _b that a path connects."""
        kind = p[0]
        if kind == "iri":
            return self.scan(("var", "_a"), ("term", p[1]), ("var", "_b")).df.distinct()
        if kind == "inv":
            return self.path_pairs(p[1]).select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))
        if kind == "alt":
            return self.path_pairs(p[1]).unionByName(self.path_pairs(p[2])).distinct()
        if kind == "seq":
            left = self.path_pairs(p[1]).select("_a", F.col("_b").alias("_m"))
            right = self.path_pairs(p[2]).select(F.col("_a").alias("_m"), "_b")
            return left.join(right, "_m").select("_a", "_b").distinct()
        nodes = self.triples.select(self._subject().alias("_a")).unionByName(
            self.triples.where("o_kind <> 'literal'").select(term_of(F.col("o"), F.col("o_kind"), F.col("o_datatype")).alias("_a"))
        ).distinct()
        loops = nodes.select("_a", F.col("_a").alias("_b"))
        step = self.path_pairs(p[1])
        if kind == "opt":
            return loops.unionByName(step).distinct()
        step = materialize(step, "path-step")
        reached, front = step, step
        while not front.isEmpty():  # ends: there are finitely many pairs
            longer = front.select("_a", F.col("_b").alias("_m")).join(step.select(F.col("_a").alias("_m"), "_b"), "_m").select("_a", "_b").distinct()
            front = materialize(longer.join(reached, ["_a", "_b"], "left_anti"), "path-front")
            reached = reached.unionByName(front)
        return reached if kind == "more" else loops.unionByName(reached).distinct()

    def reached_from(self, p: tuple, start: str, backwards: bool) -> DataFrame:
        """_a: the nodes that lead from ``start`` along the path, or to it. Only what is reached is ever joined."""
        kind = p[0]
        if kind == "inv":
            return self.reached_from(p[1], start, not backwards)
        if kind not in ("more", "any"):
            near, far = ("_b", "_a") if backwards else ("_a", "_b")
            return self.path_pairs(p).where(F.col(near) == start).select(F.col(far).alias("_a")).distinct()
        step = self.path_pairs(p[1]).select(*([F.col("_b").alias("_m"), "_a"] if backwards else [F.col("_a").alias("_m"), F.col("_b").alias("_a")]))
        step = materialize(step, "path-step")
        front = materialize(step.where(F.col("_m") == start).select("_a").distinct(), "path-front")
        reached = front
        while not front.isEmpty():
            front = materialize(step.join(front.select(F.col("_a").alias("_m")), "_m", "left_semi").select("_a").distinct().join(reached, "_a", "left_anti"), "path-front")
            reached = reached.unionByName(front)
        if kind == "any":
            reached = reached.unionByName(self.spark.createDataFrame([(start,)], "_a string")).distinct()
        return reached

    def _subject(self) -> Column:
        return F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))

    def pattern(self, s: tuple, p: tuple, o: tuple) -> Solutions:
        if p[0] in ("iri", "var"):
            return self.scan(s, ("term", p[1]) if p[0] == "iri" else p, o)
        if (s[0] == "term") != (o[0] == "term"):
            backwards = o[0] == "term"
            found = self.reached_from(p, o[1] if backwards else s[1], backwards)
            name = s[1] if backwards else o[1]
            return Solutions(found.select(F.col("_a").alias(name)), {name})
        if s[0] == "term":
            found = self.reached_from(p, s[1], False).where(F.col("_a") == o[1])
            return Solutions(found.select(F.lit(1).alias("_hit")).limit(1), set())
        df = self.path_pairs(p)
        columns = {}
        if s[0] == "var":
            columns[s[1]] = F.col("_a")
        if o[0] == "var":
            if o == s:
                df = df.where(F.col("_a") == F.col("_b"))
            columns[o[1]] = F.col("_b")
        return Solutions(df.select(*[c.alias(v) for v, c in columns.items()]) if columns else df.select(F.lit(1).alias("_hit")).limit(1), set(columns))

    def text_search(self, parts: list[tuple]) -> tuple[list[Solutions], list[tuple]]:
        """Full-text patterns and the other parts."""
        is_call = lambda t, name: t[0] == "triple" and t[2] == ("iri", f"<{name}>")
        words = {t[1][1]: t[3][1] for t in parts if is_call(t, CONTAINS_WORD)}
        if not words:
            return [], parts
        if self.keyword is None:
            raise SparqlError("there is no text index")
        found = []
        for record, term in words.items():
            word = _unquote(term)
            hits = self.keyword(word.rstrip("*").lower(), word.endswith("*"))
            entities = [t[3][1] for t in parts if is_call(t, CONTAINS_ENTITY) and t[1][1] == record]
            name = entities[0] if entities else f"_text_{record}"
            score = Value(F.col("score"), "num").term()
            df = hits.select(F.col("chunk").alias(record), F.col("text").alias(name), score.alias(f"ql_score_{record}_var_{name}"))
            found.append(Solutions(df, {record, name, f"ql_score_{record}_var_{name}"}))
        return found, [t for t in parts if not is_call(t, CONTAINS_WORD) and not is_call(t, CONTAINS_ENTITY)]

    def group(self, g: Group) -> Solutions:
        texts, parts = self.text_search(g.parts)
        got: Solutions | None = None
        for t in texts:
            got = self.meet(got, t)
        later = []
        for part in parts:
            kind = part[0]
            if kind == "triple":
                got = self.meet(got, self.pattern(*part[1:]))
            elif kind == "values":
                _, names, rows = part
                schema = ", ".join(f"`{n}` string" for n in names)
                df = F.broadcast(self.spark.createDataFrame([tuple(r) for r in rows], schema))  # as long as the query text
                loose = {n for i, n in enumerate(names) if any(r[i] is None for r in rows)}
                got = self.meet(got, Solutions(df, set(names) - loose, loose))
            elif kind == "union":
                arms = [self.group(x) for x in part[1]]
                names = set().union(*(x.names for x in arms))
                df = reduce(DataFrame.unionByName, [x.df.select(*[F.col(n) if n in x.names else F.lit(None).cast("string").alias(n) for n in sorted(names)]) for x in arms])
                sure = set.intersection(*(x.sure for x in arms))
                got = self.meet(got, Solutions(df, sure, names - sure))
            elif kind == "optional":
                inner = Group([p for p in part[1].parts if p[0] not in ("filter",)])
                conditions = [p for p in part[1].parts if p[0] == "filter"]
                right, left = self.group(inner), got or self.unit()
                extra = None
                if conditions:
                    extra = self._optional_condition(left, right, [c[1] for c in conditions])
                got = self.join(left, right, "left", extra)
            elif kind == "minus":
                left, right = got or self.unit(), self.group(part[1])
                if left.names & right.names:
                    right = Solutions(right.df.select(*sorted(left.names & right.names)).distinct(), right.sure & left.names, right.maybe & left.names)
                    got = self.join(left, right, "left_anti")
            elif kind == "bind":
                left = got or self.unit()
                value = self.value(part[2], left.names).term()
                got = Solutions(left.df.withColumn(part[1], value), left.sure, left.maybe | {part[1]})
            elif kind == "select":
                got = self.meet(got, self.select(part[1]))
            else:
                later.append(part)
        got = got or self.unit()
        for part in later:
            if part[0] == "filter":
                got = self.filtered(got, part[1])
            else:
                got = self.join(got, self.tested(got, part[1]), "left_semi" if part[2] else "left_anti")
        return got

    def tested(self, got: Solutions, g: Group) -> Solutions:
        """What an EXISTS group must agree with."""
        inner = self.group(g)
        shared = got.names & inner.names
        return Solutions(inner.df.select(*sorted(shared)).distinct() if shared else inner.df.limit(1), inner.sure & shared, inner.maybe & shared)

    def filtered(self, got: Solutions, e: tuple) -> Solutions:
        """Solutions for which an expression is true. Each EXISTS in it splits them into those it holds for and the others, which are marked."""
        marks: list[str] = []

        def marked(x):
            nonlocal got
            if isinstance(x, tuple) and x[:1] == ("exists",):
                inner, name = self.tested(got, x[1]), f"_exists{len(marks)}"
                parts = [self.join(got, inner, how).df.select(*got.df.columns, F.lit(holds == x[2]).alias(name)) for how, holds in (("left_semi", True), ("left_anti", False))]
                marks.append(name)
                got = Solutions(parts[0].unionByName(parts[1]), got.sure, got.maybe)
                return "col", Value(F.col(name), "bool")
            if isinstance(x, tuple):
                return tuple(marked(y) for y in x)
            return [marked(y) for y in x] if isinstance(x, list) else x

        e = marked(e)
        return Solutions(got.df.where(self.value(e, got.names).truth()).drop(*marks), got.sure, got.maybe)

    def _optional_condition(self, left: Solutions, right: Solutions, conditions: list[tuple]) -> Column:
        names = left.names | right.names
        return reduce(lambda a, b: a & b, (self.value(c, names).truth() for c in conditions))

    # -- expressions

    def value(self, e: tuple, names: set[str]) -> Value:
        kind = e[0]
        rest = lambda x: self.value(x, names)
        if kind == "var":
            return Value(F.col(e[1]) if e[1] in names else F.lit(None).cast("string"), "term")
        if kind == "term":
            m = re.fullmatch(rf'"([^"]*)"\^\^<{re.escape(XSD)}(integer|decimal|double)>', e[1])
            return Value(F.lit(float(m[1])), "num") if m else Value(F.lit(e[1]), "term")
        if kind == "col":
            return e[1]
        if kind in ("or", "and"):
            a, b = rest(e[1]).truth(), rest(e[2]).truth()
            return Value(a | b if kind == "or" else a & b, "bool")
        if kind == "not":
            return Value(~rest(e[1]).truth(), "bool")
        if kind == "cmp":
            return Value(self.compare(e[1], rest(e[2]), rest(e[3])), "bool")
        if kind == "in":
            x = rest(e[1])
            return Value(reduce(lambda a, b: a | b, (self.compare("=", x, rest(y)) for y in e[2]), F.lit(False)), "bool")
        if kind == "calc":
            a, b = rest(e[2]).num(), rest(e[3]).num()
            return Value({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b)}[e[1]](), "num")
        if kind == "call":
            return self.call(e[1], e[2], names)
        raise SparqlError(f"{kind} cannot stand here")

    def compare(self, sign: str, a: Value, b: Value) -> Column:
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[sign]
        if "num" in (a.kind, b.kind):
            return test(a.num(), b.num())
        if a.kind == b.kind == "term" and sign in ("=", "!="):
            typed = lambda v: F.when(v.col.rlike(rf'"\^\^<{XSD}(integer|decimal|double)>$'), v.num())
            return F.coalesce(test(typed(a), typed(b)), test(a.col, b.col))
        return F.coalesce(test(a.num(), b.num()), test(a.text(), b.text()))

    def call(self, name: str, args: list[tuple], names: set[str]) -> Value:
        if name == "BOUND":
            return Value(F.col(args[0][1]).isNotNull() if args[0][1] in names else F.lit(False), "bool")
        v = [self.value(a, names) for a in args]
        text = lambda i: v[i].text()
        if name == "COALESCE":
            return Value(F.coalesce(*[x.term() for x in v]), "term")
        if name == "IF":
            return Value(F.when(v[0].truth(), v[1].term()).otherwise(v[2].term()), "term")
        if name.startswith("CAST:"):
            kind = name.rpartition("#")[2]
            if kind in ("integer", "int", "long", "decimal", "double", "float"):
                x = v[0].num()
                return Value(F.floor(x).cast("double") if kind in ("integer", "int", "long") else x, "num")
            return Value(v[0].truth(), "bool") if kind == "boolean" else Value(text(0), "str")
        strings = {
            "STR": lambda: text(0), "LCASE": lambda: F.lower(text(0)), "UCASE": lambda: F.upper(text(0)), "CONCAT": lambda: F.concat(*[x.text() for x in v]),
            "REPLACE": lambda: F.regexp_replace(text(0), text(1), text(2)),
            "SUBSTR": lambda: F.substring(text(0), v[1].num().cast("int"), v[2].num().cast("int")) if len(v) > 2 else F.substring(text(0), v[1].num().cast("int"), F.length(text(0))),
            "STRBEFORE": lambda: F.when(F.contains(text(0), text(1)), F.split_part(text(0), text(1), F.lit(1))).otherwise(""),
            "STRAFTER": lambda: F.when(F.contains(text(0), text(1)), F.substring(text(0), F.position(text(1), text(0)) + F.length(text(1)), F.length(text(0)))).otherwise(""),
        }
        bools = {
            "REGEX": lambda: F.rlike(text(0), F.concat(F.lit("(?i)"), text(1)) if len(v) > 2 else text(1)), "CONTAINS": lambda: F.contains(text(0), text(1)),
            "STRSTARTS": lambda: F.startswith(text(0), text(1)), "STRENDS": lambda: F.endswith(text(0), text(1)),
            "ISIRI": lambda: v[0].term().startswith("<"), "ISURI": lambda: v[0].term().startswith("<"), "ISBLANK": lambda: v[0].term().startswith("_:"),
            "ISLITERAL": lambda: v[0].term().startswith('"'), "ISNUMERIC": lambda: v[0].num().isNotNull(), "SAMETERM": lambda: v[0].term() == v[1].term(),
        }
        numbers = {
            "STRLEN": lambda: F.length(text(0)), "ABS": lambda: F.abs(v[0].num()), "CEIL": lambda: F.ceil(v[0].num()), "FLOOR": lambda: F.floor(v[0].num()),
            "ROUND": lambda: F.floor(v[0].num() + 0.5),
        }
        if name == "DATATYPE":
            return Value(F.when(v[0].term().startswith('"'), F.concat(F.lit("<"), F.coalesce(F.nullif(F.regexp_extract(v[0].term(), r'"\^\^<([^>]*)>$', 1), F.lit("")), F.lit(XSD + "string")), F.lit(">"))), "term")
        for table, kind in ((strings, "str"), (bools, "bool"), (numbers, "num")):
            if name in table:
                col = table[name]()
                return Value(col.cast("double") if kind == "num" else col, kind)
        raise SparqlError(f"unknown function {name}")

    # -- forms

    def aggregate(self, e: tuple, names: set[str]) -> Value:
        _, name, distinct, inner, between = e
        if inner is None:
            return Value((F.countDistinct(F.struct(*sorted(names))) if distinct and names else F.count(F.lit(1))).cast("double"), "num")
        x = self.value(inner, names)
        if name == "COUNT":
            return Value((F.countDistinct(x.term()) if distinct else F.count(x.term())).cast("double"), "num")
        if name == "SUM":
            return Value(F.coalesce(F.sum_distinct(x.num()) if distinct else F.sum(x.num()), F.lit(0.0)), "num")
        if name == "AVG":
            return Value(F.coalesce(F.avg(x.num()), F.lit(0.0)), "num")
        if name in ("MIN", "MAX"):
            f = F.min if name == "MIN" else F.max
            best = f(F.struct(x.num().alias("n"), x.text().alias("t"), x.term().alias("v")))
            return Value(best.getField("v"), "term")
        if name == "SAMPLE":
            return Value(F.min(x.term()), "term")
        texts = F.collect_set(x.text()) if distinct else F.collect_list(x.text())
        return Value(F.concat_ws(between, F.array_sort(texts)), "str")

    def _lift(self, e: tuple, found: list[tuple]) -> tuple:
        """The expression with its aggregates replaced by columns, which are added to ``found``."""
        if not isinstance(e, tuple):
            return e
        if e[0] == "agg":
            name = f"_agg{len(found)}"
            found.append((name, e))
            return "lifted", name
        return tuple([self._lift(x, found) for x in part] if isinstance(part, list) else self._lift(part, found) if isinstance(part, tuple) else part for part in e)

    def select(self, q: Query) -> Solutions:
        got = self.group(q.where)
        aggregated = bool(q.group_by) or any(e is not None and self._has_aggregate(e) for _, e in q.items) or bool(q.having)
        items = [(n, ("var", n)) for n in sorted(got.names) if not n.startswith("_")] if q.star else [(n, e if e is not None else ("var", n)) for n, e in q.items]
        kinds: dict[str, str] = {}
        if aggregated:
            df = got.df
            keys = []
            for name, e in q.group_by:
                if e is not None:
                    df = df.withColumn(name, self.value(e, got.names).term())
                keys.append(name)
            found: list[tuple] = []
            items = [(n, self._lift(e, found)) for n, e in items]
            having = [self._lift(e, found) for e in q.having]
            order = [(self._lift(e, found), down) for e, down in q.order_by]
            columns = []
            for name, e in found:
                value = self.aggregate(e, got.names)
                kinds[name] = value.kind
                columns.append(value.col.alias(name))
            df = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
            names = set(keys)
            lifted = self._with_lifted(kinds)
            for e in having:
                df = df.where(lifted(e, names).truth())
            sure = got.sure & names
        else:
            df, names, order, sure = got.df, got.names, q.order_by, got.sure
            lifted = self.value
        out = Solutions(df, sure, names - sure)
        for name, e in items:
            if e != ("var", name):
                value = lifted(e, names | {n for n, _ in items})
                df = df.withColumn(name, value.term())
        visible = [n for n, _ in items]
        df = df.select("*", *[F.lit(None).cast("string").alias(n) for n in visible if n not in df.columns])
        if order:
            keys = []
            for i, (e, down) in enumerate(order):
                value = lifted(e, set(df.columns))
                for j, col in enumerate((value.num(), value.text())):
                    df = df.withColumn(f"_o{i}_{j}", col)
                    keys.append(F.col(f"_o{i}_{j}").desc_nulls_last() if down else F.col(f"_o{i}_{j}").asc_nulls_first())
            if not q.distinct:
                df = df.orderBy(*keys, *[F.col(v) for v in visible])
                if q.limit is not None or q.offset:
                    df = self._cut(df, q)
                return Solutions(df.select(*visible), out.sure & set(visible), set(visible) - out.sure)
            df = df.groupBy(*visible).agg(*[F.first(k).alias(k) for k in df.columns if re.fullmatch(r"_o\d+_\d", k)]).orderBy(*keys, *[F.col(v) for v in visible])
            return Solutions(self._cut(df, q).select(*visible), out.sure & set(visible), set(visible) - out.sure)
        df = df.select(*visible)
        if q.distinct:
            df = df.distinct()
        if q.limit is not None or q.offset:
            df = self._cut(df.orderBy(*visible), q)  # which rows is left open by the standard; the least ones are always the same
        return Solutions(df, out.sure & set(visible), set(visible) - out.sure)

    def _cut(self, df: DataFrame, q: Query) -> DataFrame:
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df

    def _has_aggregate(self, e) -> bool:
        if isinstance(e, tuple):
            return e[:1] == ("agg",) or any(self._has_aggregate(x) for x in e)
        return isinstance(e, list) and any(self._has_aggregate(x) for x in e)

    def _with_lifted(self, kinds: dict[str, str]) -> Callable[[tuple, set[str]], Value]:
        def swap(e):
            if isinstance(e, tuple) and e[:1] == ("lifted",):
                return "col", Value(F.col(e[1]), kinds[e[1]])
            if isinstance(e, tuple):
                return tuple(swap(x) for x in e)
            return [swap(x) for x in e] if isinstance(e, list) else e

        return lambda e, names: self.value(swap(e), names)

    def describe(self, q: Query) -> DataFrame:
        """s, p, o as terms: all triples of the named resources, and of what the named variables are bound to."""
        terms = [n[1] for n in q.template if n[0] == "term"]
        found = self.spark.createDataFrame([(x,) for x in terms], "node string")
        if q.where.parts:
            got = self.group(q.where)
            names = sorted(got.names) if q.star else [n[1] for n in q.template if n[0] == "var" and n[1] in got.names]
            for name in names:
                found = found.unionByName(self._cut(got.df.select(F.col(name).alias("node")), q))
        node = found.where("node is not null").distinct()
        t = self.triples.select(self._subject().alias("s"), F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), term_of(F.col("o"), F.col("o_kind"), F.col("o_datatype")).alias("o"))
        return t.join(node, t.s == node.node, "left_semi").distinct()

    def construct(self, q: Query) -> DataFrame:
        """s, p, o as terms; the solutions' distinct triples without those that have an unbound part."""
        got = self.group(q.where)
        cell = lambda n: F.col(n[1]) if n[0] == "var" else F.lit(n[1])
        made = [F.struct(cell(s).alias("s"), cell(("term", p[1]) if p[0] == "iri" else p).alias("p"), cell(o).alias("o")) for s, p, o in q.template]
        return got.df.select(F.explode(F.array(*made)).alias("t")).select("t.*").where("s is not null and p is not null and o is not null").distinct()


def as_triples(terms: DataFrame) -> DataFrame:
    """Written terms s, p, o as rows of the triple view."""
    o = F.col("o")
    return terms.select(
        lexical(F.col("s")).alias("s"), lexical(F.col("p")).alias("p"), lexical(o).alias("o"),
        F.when(o.startswith("<"), "iri").when(o.startswith("_:"), "bnode").otherwise("literal").alias("o_kind"),
        F.when(o.startswith('"'), F.coalesce(F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit("")), F.lit(XSD + "string"))).alias("o_datatype"),
    )


def run(triples: DataFrame, text: str, keyword: Callable[[str, bool], DataFrame] | None = None) -> DataFrame:
    """A query's result with its values as plain text: SELECT its variables, ASK one boolean ``ask``, CONSTRUCT and DESCRIBE s, p, o."""
    q = parse(text)
    c = Compiler(triples, keyword)
    if q.form == "select":
        got = c.select(q)
        return got.df.select(*[lexical(F.col(v)).alias(v) for v in got.df.columns])
    if q.form == "ask":
        return c.group(q.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    if q.form in ("construct", "describe"):
        return getattr(c, q.form)(q).select(*[lexical(F.col(x)).alias(x) for x in ("s", "p", "o")])
    raise SparqlError("an update is no query")


TRIPLE_KEY = ["s", "p", "o", "o_kind", "o_datatype"]


def change_of(triples: DataFrame, text: str) -> tuple[str, DataFrame]:
    """("insert" or "delete", the distinct triples) of INSERT DATA, DELETE DATA, INSERT ... WHERE, DELETE ... WHERE or DELETE WHERE."""
    q = parse(text)
    if q.form not in ("insert", "delete"):
        raise SparqlError("a query is no update")
    c = Compiler(triples)
    if q.where.parts:
        change = as_triples(c.construct(q))
    else:
        rows = [(s[1], p[1], o[1]) for s, p, o in q.template]
        if any(n[0] == "var" for t in q.template for n in t):
            raise SparqlError("DATA has no variables")
        change = as_triples(triples.sparkSession.createDataFrame(rows, "s string, p string, o string"))
    return q.form, change.distinct()


def minus(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples without those of ``gone``; datatypes are compared too."""
    gone = gone.select(*[F.col(c).alias(f"_{c}") for c in TRIPLE_KEY])
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TRIPLE_KEY))
    return triples.join(gone, same, "left_anti")


def update(triples: DataFrame, text: str) -> DataFrame:
    """The triples after an update (see :func:`change_of`)."""
    form, change = change_of(triples, text)
    return triples.unionByName(minus(change, triples)) if form == "insert" else minus(triples, change)
