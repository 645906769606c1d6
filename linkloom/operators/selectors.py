"""Node selection by a subset of XPath, compiled to Column predicates so that any number of selectors runs in one pass."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..schemas import PAGE_TAG

DEFAULT_XPATH = "//*[not(self::html)]"


class XPathError(ValueError):
    """An expression outside of the subset."""


@dataclass(frozen=True)
class Selector:
    """A named selection: ``xpath`` and, optionally, a string that the inner text must contain."""

    slot: str
    xpath: str = DEFAULT_XPATH
    content_match: str | None = None


_TOKENS = re.compile(r"\s*(and\b|or\b|not\b|contains\b|text\(\)|self::[\w:-]+|@[\w:-]+|'[^']*'|\"[^\"]*\"|[()=,])")
_STEP = re.compile(r"""\s*\.?//(\*|[\w:-]+)((?:\[(?:[^\]'"]|'[^']*'|"[^"]*")*\])*)\s*""")
_BRACKET = re.compile(r"""\[((?:[^\]'"]|'[^']*'|"[^"]*")*)\]""")
_BAR = re.compile(r"""\|(?=(?:[^'"]|'[^']*'|"[^"]*")*$)""")

#: A test of a node: self (tag is value), has (attribute name is there), equals and contains (of an attribute, or of the own text where name is null); negated or not.
TEST = "struct<negated: boolean, kind: string, name: string, value: string>"
#: Alternatives, each a tag (or *) and tests that must all hold.
TESTS = f"array<struct<tag: string, tests: array<{TEST}>>>"


class _Predicate:
    """Recursive descent over a predicate: or, and, not(...), self::tag, @a, @a='v', text()='v', contains(@a|text(), 'v').

    The result is a disjunction of conjunctions of tests; not(...) is carried inwards on the way."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text.rstrip()):
            m = _TOKENS.match(text, at)
            if not m:
                raise XPathError(f"can't read [{text}] at {at}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def _next(self, *wanted: str) -> str:
        got = self.tokens[self.at] if self.at < len(self.tokens) else None
        if got is None or (wanted and got not in wanted):
            raise XPathError(f"can't read [{self.text}]: {got!r} where {' or '.join(wanted) or 'more'} is needed")
        self.at += 1
        return got

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def parse(self) -> list[list[tuple]]:
        result = self._or(False)
        if self._peek() is not None:
            raise XPathError(f"can't read [{self.text}]")
        return result

    def _joined(self, word: str, part, negated: bool) -> list[list[tuple]]:
        either = (word == "or") != negated
        result = part(negated)
        while self._peek() == word:
            self._next()
            right = part(negated)
            result = result + right if either else [x + y for x in result for y in right]
        return result

    def _or(self, negated: bool) -> list[list[tuple]]:
        return self._joined("or", self._and, negated)

    def _and(self, negated: bool) -> list[list[tuple]]:
        return self._joined("and", self._unit, negated)

    def _string(self) -> str:
        got = self._next()
        if got[0] not in "'\"":
            raise XPathError(f"a string is needed in [{self.text}]")
        return got[1:-1]

    def _value(self) -> str | None:
        """An attribute's name; None for the own text."""
        got = self._next()
        if got.startswith("@"):
            return got[1:].lower()
        if got == "text()":
            return None
        raise XPathError(f"an attribute or text() is needed in [{self.text}]")

    def _unit(self, negated: bool) -> list[list[tuple]]:
        got = self._peek()
        if got in ("(", "not"):
            if self._next() == "not":
                negated = not negated
                self._next("(")
            inner = self._or(negated)
            self._next(")")
            return inner
        if got == "contains":
            self._next()
            self._next("(")
            name = self._value()
            self._next(",")
            sought = self._string()
            self._next(")")
            return [[(negated, "contains", name, sought)]]
        if got and got.startswith("self::"):
            self._next()
            return [[(negated, "self", None, got[6:].lower())]]
        name = self._value()
        if self._peek() == "=":
            self._next()
            return [[(negated, "equals", name, self._string())]]
        return [[(negated, "has", name, None)]]


def parse_xpath(xpath: str) -> list[tuple[str, list[tuple]]]:
    """``//tag``, ``.//tag`` or ``//*`` with predicates, alternatives joined by ``|``, as alternatives of (tag, tests); see :data:`TESTS`."""
    result = []
    for one in _BAR.split(xpath):
        m = _STEP.fullmatch(one)
        if not m:
            raise XPathError(f"outside of the supported subset: {xpath!r}")
        ways: list[list[tuple]] = [[]]
        for predicate in _BRACKET.findall(m[2]):
            ways = [x + y for x in ways for y in _Predicate(predicate).parse()]
        result += [(m[1].lower(), w) for w in ways]
    return result


def _holds(negated: Column, kind: Column, name: Column, value: Column) -> Column:
    own = F.when(name.isNull(), F.col("own_text")).otherwise(F.try_element_at("attrs", F.coalesce(name, F.lit(""))))
    test = F.when(kind == "self", F.col("tag") == value).when(kind == "has", own.isNotNull()).when(kind == "equals", own == value).otherwise(F.contains(own, value))
    return F.coalesce(test, F.lit(False)) != negated


def matches_tests(tests: Column) -> Column:
    """Whether a node row matches a column of alternatives, so that every row can bring its own."""
    tag = lambda a: F.when(a["tag"] == "*", ~F.startswith("tag", F.lit("#"))).otherwise(F.col("tag") == a["tag"])
    return F.exists(tests, lambda a: tag(a) & F.forall(a["tests"], lambda t: _holds(t["negated"], t["kind"], t["name"], t["value"])))


def compile_xpath(xpath: str) -> Column:
    """An XPath of the subset as a predicate on node rows."""
    result = None
    for tag, tests in parse_xpath(xpath):
        one = ~F.startswith("tag", F.lit("#")) if tag == "*" else F.col("tag") == F.lit(tag)
        for negated, kind, name, value in tests:
            own = F.col("own_text") if name is None else F.element_at("attrs", F.lit(name))
            test = F.col("tag") == F.lit(value) if kind == "self" else own.isNotNull() if kind == "has" else own == F.lit(value) if kind == "equals" else F.contains(own, F.lit(value))
            test = F.coalesce(test, F.lit(False))
            one = one & (~test if negated else test)
        result = one if result is None else result | one
    return result


def compile_definitions(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(compiled, rejects) of part definitions with an xpath: compiled have tests (see :data:`TESTS`), rejects an error. Each text is read once, in the tasks; a missing one is the default."""
    texts = definitions.select(F.coalesce("xpath", F.lit(DEFAULT_XPATH)).alias("xpath")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["xpath"]:
                try:
                    found = [{"tag": tag, "tests": [dict(zip(("negated", "kind", "name", "value"), t, strict=True)) for t in tests]} for tag, tests in parse_xpath(text)]
                    rows.append((text, found, None))
                except XPathError as error:
                    rows.append((text, None, str(error)))
            yield pd.DataFrame(rows, columns=["xpath", "tests", "error"])

    read = texts.mapInPandas(run, f"xpath string, tests {TESTS}, error string")
    joined = definitions.withColumn("xpath", F.coalesce("xpath", F.lit(DEFAULT_XPATH))).join(read, "xpath", "left")
    return joined.where("error is null").drop("error"), joined.where("error is not null").drop("tests")


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, page_text, base_uri) of every page with nodes."""
    return nodes.where(F.col("tag") == PAGE_TAG).select("page_id", F.col("own_text").alias("page_text"), F.element_at("attrs", F.lit("url")).alias("base_uri"))


def inner_text(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """``selected`` with inner_text (the texts inside each node, in order, nothing between; null without any) and base_uri (the page's url, if it was read with the page)."""
    text = F.when(F.col("text_to") > F.col("text_from"), F.substring("page_text", F.col("text_from") + 1, F.col("text_to") - F.col("text_from")))
    return selected.join(page_texts(nodes), "page_id", "left").withColumn("inner_text", text).drop("page_text")


def inside_any(points: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``points`` (node columns) at or below some node of ``spans`` of the same ``keys``: nodes are nested or apart, so one pass in page order with the
    furthest end so far tells, without a join."""
    columns = points.columns
    both = points.withColumn("_end", F.lit(None).cast("int")).unionByName(spans.select(*keys, "pre", F.col("last").alias("_end")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("pre", F.col("_end").isNull())
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_reach", reach).where("_end is null and _reach >= pre").select(*columns)


def without_children(picked: DataFrame, slot: str) -> DataFrame:
    """``picked`` without nodes whose direct parent is picked too; of nodes with one tag and outer HTML the first stays. All of it goes by page, in one partitioning."""
    columns = picked.columns
    roles = picked.withColumn("_role", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_key", F.when(F.col("_role") == 0, F.col("node_id")).otherwise(F.col("parent_id")))
    held = F.min("_role").over(Window.partitionBy("page_id", slot, "_key"))
    alone = roles.withColumn("_held", held).where((F.col("_role") == 1) & ((F.col("_held") == 1) | F.col("_key").isNull()))
    first = Window.partitionBy("page_id", slot, F.lower("tag"), "outer_hash").orderBy("pre")
    return alone.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*columns)


def select_nodes(nodes: DataFrame, selectors: Sequence[Selector]) -> DataFrame:
    """slot and node columns of what the selectors pick: XPath, then the content test, then nodes whose direct parent is picked go, then of
    nodes with one tag and outer HTML the first stays. A content test that nothing passes picks nothing."""
    if not selectors:
        raise ValueError("at least one selector is needed")
    hits = F.array(*[F.when(compile_xpath(s.xpath), F.lit(i)) for i, s in enumerate(selectors)])
    picked = nodes.withColumn("_slot", F.explode(F.filter(hits, lambda x: x.isNotNull())))
    if any(s.content_match for s in selectors):
        wanted = F.get(F.array(*[F.lit(s.content_match or "") for s in selectors]), F.col("_slot"))
        tested = inner_text(nodes, picked).where((wanted == "") | F.contains("inner_text", wanted))
        picked = tested.select(*picked.columns)
    names = F.array(*[F.lit(s.slot) for s in selectors])
    return without_children(picked, "_slot").select(F.get(names, F.col("_slot")).alias("slot"), *nodes.columns)


def select_by_definition(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """part_id and node columns of what each page's own definition picks. ``wanted`` has one row a page: page_id and selectors, an array of structs of part_id, content_match and tests.

    The nodes meet their page's selectors in one join by page, whatever the number of sites; equal selectors make files far smaller than rows, so that Spark is kept from sending them everywhere."""
    hits = F.filter("selectors", lambda s: matches_tests(s["tests"]))
    picked = nodes.where("not startswith(tag, '#')").join(wanted.select("page_id", "selectors").hint("merge"), "page_id").withColumn("_hit", F.explode(hits)).drop("selectors")
    picked = picked.select("*", F.col("_hit.part_id").alias("part_id"), F.col("_hit.content_match").alias("_match")).drop("_hit")
    tested = inner_text(nodes, picked).where("_match is null or contains(inner_text, _match)")
    return without_children(tested.select("part_id", *nodes.columns), "part_id")


def node_lines(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """``selected`` with line: the inner text with its lines trimmed, blank ones dropped, joined by one space; empty without text. base_uri is the page's url, if it was read with the page."""
    return inner_text(nodes, selected).withColumn("line", F.coalesce(one_line(F.col("inner_text")), F.lit(""))).drop("inner_text")
