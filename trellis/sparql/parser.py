"""Recursive-descent parser of SPARQL 1.1 queries, with window calls as an extension of expressions."""

from __future__ import annotations

import re
from decimal import Decimal
from urllib.parse import urljoin

from trellis.errors import QuerySyntaxError
from trellis.sparql import ast as A
from trellis.sparql.lexer import Token, tokens, unquote

# Names of the language.
AGGREGATES = frozenset("COUNT SUM AVG MIN MAX SAMPLE GROUP_CONCAT".split())
WINDOW_ONLY = frozenset("RANK DENSE_RANK ROW_NUMBER PERCENT_RANK CUME_DIST NTILE LAG LEAD FIRST_VALUE LAST_VALUE".split())
STANDARD_PREFIXES = {
    "rdf": A.RDF, "rdfs": A.RDFS, "owl": A.OWL, "xsd": A.XSD,
    "geo": "http://www.opengis.net/ont/geosparql#", "geof": "http://www.opengis.net/def/function/geosparql/", "uom": "http://www.opengis.net/def/uom/OGC/1.0/",
}
_LEVELS = [{"||"}, {"&&"}, {"=", "!=", "<", "<=", ">", ">="}, {"+", "-"}, {"*", "/"}]


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.text, self.tokens, self.at = text, tokens(text), 0
        self.prefixes, self.base, self.blanks = dict(STANDARD_PREFIXES) | (prefixes or {}), "", 0

    # tokens -------------------------------------------------------------------
    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", len(self.text))

    def next(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def fail(self, wanted: str):
        token = self.peek()
        line = self.text.count("\n", 0, token.at) + 1
        raise QuerySyntaxError(f"line {line}: {wanted} expected, found {token.text or 'the end'!r}")

    def is_op(self, *ops: str) -> bool:
        return self.peek().kind == "op" and self.peek().text in ops

    def is_word(self, *words: str) -> bool:
        return self.peek().kind == "word" and self.peek().upper in words

    def op(self, text: str) -> bool:
        if self.is_op(text):
            self.at += 1
            return True
        return False

    def word(self, *words: str) -> str | None:
        return self.next().upper if self.is_word(*words) else None

    def need(self, text: str) -> None:
        if not self.op(text):
            self.fail(repr(text))

    def need_word(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)

    # query --------------------------------------------------------------------
    def query(self) -> A.Query:
        self.prologue()
        form = self.word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE")
        if form == "SELECT":
            found = self.select()
        elif form == "ASK":
            sources = self.datasets()
            self.word("WHERE")
            found = A.Query("ASK", self.group(), **sources)
        elif form == "CONSTRUCT":
            found = self.construct()
        elif form == "DESCRIBE":
            found = self.describe()
        else:
            self.fail("SELECT, ASK, CONSTRUCT or DESCRIBE")
        if form != "SELECT":
            found = self.modifiers(found)
        if self.peek().kind != "end":
            self.fail("the end")
        return found

    def prologue(self) -> None:
        while kind := self.word("PREFIX", "BASE"):
            if kind == "PREFIX":
                name = self.next()
                if name.kind != "name" or not name.text.endswith(":"):
                    self.fail("a prefix")
                self.prefixes[name.text[:-1]] = self.iri_ref()
            else:
                self.base = self.iri_ref()

    def iri_ref(self) -> str:
        token = self.next()
        if token.kind != "iri":
            self.fail("an IRI")
        iri = token.text[1:-1]
        return urljoin(self.base, iri) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", iri) else iri

    def datasets(self) -> dict:
        plain, named = [], []
        while self.word("FROM"):
            (named if self.word("NAMED") else plain).append(self.iri().value)
        return {"sources": tuple(plain), "named_sources": tuple(named)}

    def select(self) -> A.Query:
        distinct = self.word("DISTINCT", "REDUCED") == "DISTINCT"
        projection = []
        if not self.op("*"):
            while True:
                if self.peek().kind == "var":
                    projection.append(A.Projection(A.Var(self.next().text[1:])))
                elif self.op("("):
                    expression = self.expression()
                    self.need_word("AS")
                    projection.append(A.Projection(self.var(), expression))
                    self.need(")")
                else:
                    break
            if not projection:
                self.fail("a projection")
        sources = self.datasets()
        self.word("WHERE")
        return self.modifiers(A.Query("SELECT", self.group(), tuple(projection), distinct, prefixes=dict(self.prefixes), **sources))

    def construct(self) -> A.Query:
        if self.is_op("{"):
            self.need("{")
            template = self.triples(until="}")
            self.need("}")
            sources = self.datasets()
            self.word("WHERE")
            return A.Query("CONSTRUCT", self.group(), template=tuple(template), **sources)
        sources = self.datasets()
        self.need_word("WHERE")
        group = self.group()
        return A.Query("CONSTRUCT", group, template=tuple(x for x in group.elements if isinstance(x, A.Triple)), **sources)

    def describe(self) -> A.Query:
        terms = []
        if not self.op("*"):
            while self.peek().kind in ("var", "iri", "name"):
                terms.append(self.var() if self.peek().kind == "var" else self.iri())
        sources = self.datasets()
        where = A.Group(())
        if self.word("WHERE") or self.is_op("{"):
            where = self.group()
        return A.Query("DESCRIBE", where, describe=tuple(terms), **sources)

    def modifiers(self, q: A.Query) -> A.Query:
        out = dict(q.__dict__)
        group_by, having, order_by = [], [], []
        if self.word("GROUP"):
            self.need_word("BY")
            while True:
                if self.peek().kind == "var":
                    group_by.append(A.Projection(self.var()))
                elif self.op("("):
                    expression = self.expression()
                    if self.word("AS"):
                        group_by.append(A.Projection(self.var(), expression))
                    else:
                        group_by.append(expression)
                    self.need(")")
                elif self.is_call():
                    group_by.append(self.primary())
                else:
                    break
        if self.word("HAVING"):
            while self.is_op("(") or self.is_call():
                having.append(self.primary())
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                way = self.word("ASC", "DESC")
                if way or self.is_op("("):
                    expression = self.primary()
                elif self.peek().kind == "var" or self.is_call():
                    expression = self.primary()
                else:
                    break
                way = way or self.word("ASC", "DESC")  # also after the key
                order_by.append((expression, way == "DESC"))
        limit = offset = None
        while kind := self.word("LIMIT", "OFFSET"):
            token = self.next()
            if token.kind != "number" or not token.text.isdigit():
                self.fail("a whole number")
            if kind == "LIMIT":
                limit = int(token.text)
            else:
                offset = int(token.text)
        values = self.values() if self.word("VALUES") else None
        return A.Query(**out | {"group_by": tuple(group_by), "having": tuple(having), "order_by": tuple(order_by), "limit": limit, "offset": offset, "values": values})

    # graph patterns -----------------------------------------------------------
    def group(self) -> A.Group:
        self.need("{")
        if self.is_word("SELECT"):
            self.next()
            inner = self.select()
            self.need("}")
            return A.Group((A.SubSelect(inner),))
        elements: list = []
        while not self.op("}"):
            if self.peek().kind == "end":
                self.fail("'}'")
            self.element(elements)
            self.op(".")
        return A.Group(tuple(elements))

    def element(self, elements: list) -> None:
        if self.word("FILTER"):
            elements.append(A.Filter(self.primary()))
        elif self.word("OPTIONAL"):
            elements.append(A.Optional(self.group()))
        elif self.word("MINUS"):
            elements.append(A.Minus(self.group()))
        elif self.word("BIND"):
            self.need("(")
            expression = self.expression()
            self.need_word("AS")
            elements.append(A.Bind(expression, self.var()))
            self.need(")")
        elif self.word("VALUES"):
            elements.append(self.values())
        elif self.word("GRAPH"):
            name = self.var() if self.peek().kind == "var" else self.iri()
            elements.append(A.Graph(name, self.group()))
        elif self.word("SERVICE"):
            silent = bool(self.word("SILENT"))
            endpoint = self.var() if self.peek().kind == "var" else self.iri()
            begin = self.peek().at
            group = self.group()
            end = self.tokens[self.at - 1].at + 1
            elements.append(A.Service(endpoint, group, silent, self.text[begin:end]))
        elif self.is_op("{"):
            branches = [self.group()]
            while self.word("UNION"):
                branches.append(self.group())
            elements.append(A.Union(tuple(branches)) if len(branches) > 1 else branches[0])
        else:
            elements.extend(self.triples(until="}"))

    def values(self) -> A.Values:
        if self.peek().kind == "var":
            names, single = [self.var()], True
        else:
            self.need("(")
            names, single = [], False
            while not self.op(")"):
                names.append(self.var())
        self.need("{")
        rows = []
        while not self.op("}"):
            if single:
                rows.append((self.value(),))
                continue
            self.need("(")
            row = []
            while not self.op(")"):
                row.append(self.value())
            if len(row) != len(names):
                self.fail(f"{len(names)} values")
            rows.append(tuple(row))
        return A.Values(tuple(names), tuple(rows))

    def value(self):
        if self.word("UNDEF"):
            return None
        sign = "-" if self.op("-") else ("" if not self.op("+") else "")
        term = self.term()
        return A.Literal(-term.value, term.datatype) if sign else term

    def triples(self, until: str) -> list[A.Triple]:
        found: list[A.Triple] = []
        subject = self.node(found)
        self.properties(subject, found, optional=bool(found))
        while self.op("."):
            if self.is_op(until) or self.peek().kind == "end" or self.is_word("FILTER", "OPTIONAL", "MINUS", "BIND", "VALUES", "GRAPH", "SERVICE") or self.is_op("{"):
                break
            before = len(found)
            subject = self.node(found)
            self.properties(subject, found, optional=len(found) > before)
        return found

    def properties(self, subject, found: list, optional: bool = False) -> None:
        if optional and not self.begins_predicate():
            return
        while True:
            predicate = self.var() if self.peek().kind == "var" else self.path()
            while True:
                found.append(A.Triple(subject, predicate, self.node(found)))
                if not self.op(","):
                    break
            more = False
            while self.op(";"):
                more = True
            if not (more and self.begins_predicate()):
                return

    def begins_predicate(self) -> bool:
        return self.peek().kind in ("var", "iri", "name") or self.is_op("^", "!", "(") or (self.peek().kind == "word" and self.peek().text == "a")

    def node(self, found: list):
        if self.op("["):
            blank = self.fresh()
            if not self.op("]"):
                self.properties(blank, found)
                self.need("]")
            return blank
        if self.op("("):  # a collection
            items = []
            while not self.op(")"):
                items.append(self.node(found))
            rest: A.Term = A.Iri(A.RDF + "nil")
            for item in reversed(items):
                cell = self.fresh()
                found += [A.Triple(cell, A.Iri(A.RDF + "first"), item), A.Triple(cell, A.Iri(A.RDF + "rest"), rest)]
                rest = cell
            return rest
        if self.is_op("-", "+"):
            return self.value()
        return self.var() if self.peek().kind == "var" else self.term()

    def fresh(self) -> A.Blank:
        self.blanks += 1
        return A.Blank(f"b{self.blanks}")

    # paths --------------------------------------------------------------------
    def path(self):
        options = [self.path_sequence()]
        while self.op("|"):
            options.append(self.path_sequence())
        return options[0] if len(options) == 1 else A.Alternative(tuple(options))

    def path_sequence(self):
        steps = [self.path_step()]
        while self.op("/"):
            steps.append(self.path_step())
        return steps[0] if len(steps) == 1 else A.Sequence(tuple(steps))

    def path_step(self):
        if self.op("^"):
            return A.Inverse(self.path_step())
        if self.op("!"):
            return self.negated()
        if self.op("("):
            inner = self.path()
            self.need(")")
        else:
            inner = self.verb()
        while True:
            if self.op("*"):
                inner = A.Repeat(inner, 0, None)
            elif self.op("+"):
                inner = A.Repeat(inner, 1, None)
            elif self.op("?"):
                inner = A.Repeat(inner, 0, 1)
            elif self.is_op("{") and self.peek(1).kind == "number" or self.is_op("{") and self.peek(1).text == ",":
                self.next()
                least = int(self.next().text) if self.peek().kind == "number" else 0
                most: int | None = least
                if self.op(","):
                    most = int(self.next().text) if self.peek().kind == "number" else None
                self.need("}")
                inner = A.Repeat(inner, least, most)
            else:
                return inner

    def negated(self) -> A.Negated:
        forward, backward = [], []

        def one() -> None:
            (backward if self.op("^") else forward).append(self.verb().value)

        if self.op("("):
            one()
            while self.op("|"):
                one()
            self.need(")")
        else:
            one()
        return A.Negated(tuple(forward), tuple(backward))

    def verb(self) -> A.Iri:
        if self.peek().kind == "word" and self.peek().text == "a":
            self.next()
            return A.Iri(A.TYPE)
        return self.iri()

    # terms --------------------------------------------------------------------
    def var(self) -> A.Var:
        token = self.next()
        if token.kind != "var":
            self.at -= 1
            self.fail("a variable")
        return A.Var(token.text[1:])

    def iri(self) -> A.Iri:
        token = self.peek()
        if token.kind == "iri":
            return A.Iri(self.iri_ref())
        if token.kind == "name":
            self.next()
            prefix, _, local = token.text.partition(":")
            if prefix not in self.prefixes:
                raise QuerySyntaxError(f"prefix {prefix!r} is not declared")
            return A.Iri(self.prefixes[prefix] + local.replace("\\", ""))
        self.fail("an IRI")

    def term(self):
        token = self.peek()
        if token.kind in ("iri", "name"):
            return self.iri()
        if token.kind == "blank":
            return A.Blank(self.next().text[2:])
        if token.kind == "string":
            value = unquote(self.next().text)
            if self.peek().kind == "lang":
                return A.Literal(value, A.RDF + "langString", self.next().text[1:])
            if self.op("^^"):
                return typed(value, self.iri().value)
            return A.Literal(value)
        if token.kind == "number":
            text = self.next().text
            if "e" in text.lower():
                return A.Literal(float(text), A.XSD + "double")
            return A.Literal(Decimal(text), A.XSD + "decimal") if "." in text else A.Literal(int(text), A.XSD + "integer")
        if self.is_word("TRUE", "FALSE"):
            return A.Literal(self.next().upper == "TRUE", A.XSD + "boolean")
        self.fail("a term")

    # expressions --------------------------------------------------------------
    def expression(self, level: int = 0):
        if level == len(_LEVELS):
            return self.unary()
        left = self.expression(level + 1)
        while True:
            if level == 2 and self.is_word("IN"):
                self.next()
                left = A.Among(left, self.arguments(), False)
            elif level == 2 and self.is_word("NOT") and self.peek(1).upper == "IN":
                self.at += 2
                left = A.Among(left, self.arguments(), True)
            elif self.peek().kind == "op" and self.peek().text in _LEVELS[level]:
                left = A.Binary(self.next().text, left, self.expression(level + 1))
            else:
                return left

    def unary(self):
        if self.op("!"):
            return A.Unary("!", self.unary())
        if self.op("-"):
            inner = self.unary()
            if isinstance(inner, A.Literal) and isinstance(inner.value, (int, float, Decimal)) and not isinstance(inner.value, bool):
                return A.Literal(-inner.value, inner.datatype)
            return A.Unary("-", inner)
        if self.op("+"):
            return self.unary()
        return self.primary()

    def is_call(self) -> bool:
        if self.is_word("HAVING", "ORDER", "LIMIT", "OFFSET", "VALUES", "GROUP"):
            return False
        return self.peek().kind in ("word", "name", "iri") and (self.peek(1).text == "(" or self.is_word("NOT", "EXISTS"))

    def arguments(self) -> tuple:
        self.need("(")
        found = []
        while not self.op(")"):
            found.append(self.expression())
            if not self.op(",") and not self.is_op(")"):
                self.fail("',' or ')'")
        return tuple(found)

    def primary(self):
        if self.op("("):
            inner = self.expression()
            self.need(")")
            return inner
        token = self.peek()
        if token.kind == "var":
            return self.var()
        if token.kind == "word" and token.upper in ("EXISTS", "NOT"):
            negated = bool(self.word("NOT"))
            self.need_word("EXISTS")
            return A.Exists(self.group(), negated)
        if token.kind == "word" and self.peek(1).text == "(":
            return self.windowed(self.aggregate() if token.upper in AGGREGATES else A.Call(self.next().upper, self.arguments()))
        if token.kind in ("name", "iri"):
            name = self.iri()
            return A.Call(name.value, self.arguments()) if self.is_op("(") else name
        return self.term()

    def aggregate(self) -> A.Call:
        name = self.next().upper
        self.need("(")
        distinct = bool(self.word("DISTINCT"))
        args: tuple = () if self.op("*") else (self.expression(),)
        separator = None
        if self.op(";"):
            self.need_word("SEPARATOR")
            self.need("=")
            separator = unquote(self.next().text)
        self.need(")")
        return A.Call(name, args, distinct, separator)

    def windowed(self, call: A.Call) -> A.Call:
        if not self.word("OVER"):
            return call
        self.need("(")
        partition, order = [], []
        if self.word("PARTITION"):
            self.need_word("BY")
            while not self.is_op(")") and not self.is_word("ORDER"):
                partition.append(self.expression())
                self.op(",")
        if self.word("ORDER"):
            self.need_word("BY")
            while not self.is_op(")"):
                way = self.word("ASC", "DESC")
                expression = self.primary()
                way = way or self.word("ASC", "DESC")
                order.append((expression, way == "DESC"))
                self.op(",")
        self.need(")")
        return A.Call(call.name, call.args, call.distinct, call.separator, A.Over(tuple(partition), tuple(order)))


def typed(value: str, datatype: str) -> A.Literal:
    """A literal whose text is read by its datatype; unreadable text stays text."""
    short = datatype.removeprefix(A.XSD)
    try:
        if short in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt"):
            return A.Literal(int(value), A.XSD + "integer")
        if short == "decimal":
            return A.Literal(Decimal(value), datatype)
        if short in ("double", "float"):
            return A.Literal(float(value), datatype)
        if short == "boolean" and value in ("true", "false", "0", "1"):
            return A.Literal(value in ("true", "1"), datatype)
    except (ValueError, ArithmeticError):
        pass
    return A.Literal(value, datatype)


def parse(text: str, prefixes: dict[str, str] | None = None) -> A.Query:
    return Parser(text, prefixes).query()
