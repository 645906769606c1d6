"""Message exchange: declarative routing, transformers, publishers, dead letters, replay; over tables or micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import COMPONENT, ROUTE
from ..sources.staged import staged

#: Routes by url text, each of which is checked for every row, may be so many; key and type routes any number.
MAX_URL_ROUTES = 10_000

PLACE_PARTS, PLACE_CHUNK = 256, 4096

ENVELOPE = ["id", "payload_type", "payload", "routing_key", "correlation_id", "properties"]


def envelope(messages: DataFrame) -> DataFrame:
    """Messages with an id and a correlation id that defaults to it. Where the id is null it is a digest of the row; of equal rows, the second and later ones have their number after it.

    Rows that are equal in all columns are counted before they are dealt out, and numbers are given in ``PLACE_PARTS`` parts of which each goes on where the one
    before it ends, so that a message that comes without id again and again isn't one task's work."""
    columns = [F.col(f"`{c}`") for c in messages.columns]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("payload_type", "payload", "routing_key", "correlation_id")]
    missing = messages.where("id is null").select(F.sha2(F.concat_ws("\x1f", *parts), 256).alias("_digest"), F.to_json(F.struct(*columns)).alias("_other"), F.struct(*columns).alias("_row"))
    equal = missing.groupBy("_digest", "_other").agg(F.first("_row").alias("_row"), F.count("*").alias("_all"))
    chunks = equal.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {PLACE_CHUNK}"))))
    chunks = chunks.withColumn("_n", F.least(F.lit(PLACE_CHUNK), F.col("_all") - F.col("_chunk") * PLACE_CHUNK)).withColumn("_part", F.pmod(F.xxhash64("_other", "_chunk"), F.lit(PLACE_PARTS)))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy("_digest", "_part").agg(F.sum("_n").alias("_n"))
    first = sums.select("_digest", "_part", F.coalesce(F.sum("_n").over(before(["_digest"], ["_part"])), F.lit(0)).alias("_first"))
    placed = chunks.withColumn("_within", F.coalesce(F.sum("_n").over(before(["_digest", "_part"], ["_other", "_chunk"])), F.lit(0))).join(first, ["_digest", "_part"])
    placed = placed.select("_digest", "_row", (F.col("_first") + F.col("_within")).alias("_base"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_k")).withColumn("_place", F.col("_base") + F.col("_k"))
    id_ = F.when(F.col("_place") == 1, F.col("_digest")).otherwise(F.concat_ws("-", "_digest", F.lit("row"), F.col("_place").cast("string")))
    named = placed.select(*[id_.alias("id") if c == "id" else F.col("_row").getField(c).alias(c) for c in messages.columns])
    out = messages.where("id is not null").unionByName(named)
    return out.withColumn("correlation_id", F.coalesce("correlation_id", "id"))


@dataclass(frozen=True)
class Route:
    """``kind`` is key (equal routing key), type (equal payload type), url (text contained in the payload's uri) or all; ``match`` what it compares with."""

    kind: str
    match: str
    target: str


def routes_table(spark: SparkSession, routes: Sequence[Route]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.match, r.target) for r in routes], ROUTE)


def uri_of(payload: Column) -> Column:
    """The uri of a JSON payload, a plain value or the first of a list."""
    value = F.get_json_object(payload, "$.uri")
    return F.coalesce(F.get_json_object(payload, "$.uri[0]"), F.when(~value.startswith("["), value))


def _targets(messages: DataFrame, routes: DataFrame) -> DataFrame:
    """``messages`` with _targets, the set of all targets that routes name for the row.

    Keys and types are joins with one row a key, broadcast by Spark where the table is small; url texts are few."""
    def named(kind: str, column: str) -> DataFrame:
        return routes.where(F.col("kind") == kind).groupBy(F.col("match").alias(column)).agg(F.collect_set("target").alias(f"_{kind}"))

    other = [(r["kind"], r["match"], r["target"]) for r in routes.where("kind in ('url', 'all')").limit(MAX_URL_ROUTES + 1).collect()]
    if len(other) > MAX_URL_ROUTES:
        raise ValueError(f"more than {MAX_URL_ROUTES} routes by url text")
    m = messages.join(named("key", "routing_key"), "routing_key", "left").join(named("type", "payload_type"), "payload_type", "left")
    uri, none = F.lower(uri_of(F.col("payload"))), F.array().cast("array<string>")
    tests = [F.when(F.lit(True) if kind == "all" else F.contains(uri, F.lit((match or "").lower())), F.lit(target)) for kind, match, target in other]
    targets = F.flatten(F.array(F.coalesce("_key", none), F.coalesce("_type", none), F.filter(F.array(*tests), lambda t: t.isNotNull()) if tests else none))
    return m.select(*messages.columns, F.array_distinct(targets).alias("_targets"))


def route(messages: DataFrame, routes: DataFrame, components: DataFrame | None = None, exchange: str | None = None) -> DataFrame:
    """``messages`` once for each target that a route names for them, with target. Routing keys match literally, urls whatever the case.

    Every row is taken for itself, whatever ids repeat: the targets of all its routes are one set. Targets that ``components`` switches off get nothing;
    unknown ones are on.
    """
    out = _targets(messages, routes).withColumn("target", F.explode("_targets")).drop("_targets")
    return active_only(out, components, exchange) if components is not None else out


def active_only(routed: DataFrame, components: DataFrame, exchange: str | None = None) -> DataFrame:
    """Rows whose target isn't switched off."""
    switches = components.where(F.col("exchange") == exchange) if exchange else components
    off = switches.groupBy(F.col("name").alias("target")).agg(F.min(F.coalesce("is_active", F.lit(True))).alias("_on")).where("not _on")
    return routed.join(off.select("target"), "target", "left_anti").select(*routed.columns)


def register_components(components: DataFrame, found: DataFrame, as_of) -> DataFrame:
    """The switch table with new components (exchange, kind, name) added as active; those known keep their switch."""
    new = found.select("exchange", "kind", "name").distinct().join(components, ["exchange", "kind", "name"], "left_anti")
    new = new.select("exchange", "kind", "name", F.lit(True).alias("is_active"), F.lit(as_of).cast("timestamp").alias("registered_at"))
    return components.select(*[c.split()[0] for c in COMPONENT.split(", ")]).unionByName(new)


def simple_filter(messages: DataFrame, publishers: Sequence[str], test: Callable[[DataFrame], dict[str, Column]] | None = None) -> DataFrame:
    """``messages`` for each publisher whose test, made of the input, is true; no tests mean all publishers, as does a test that gives null."""
    tests = test(messages) if test else {}
    targets = F.array(*[F.when(F.coalesce(tests.get(p, F.lit(True)), F.lit(True)), F.lit(p)) for p in publishers])
    return messages.withColumn("target", F.explode(F.filter(targets, lambda t: t.isNotNull())))


def unrouted(messages: DataFrame, routed: DataFrame) -> DataFrame:
    return messages.join(routed.select("id").distinct(), "id", "left_anti")


def is_list(payload: Column) -> Column:
    return F.coalesce(payload.startswith("["), F.lit(False))


def explode_lists(messages: DataFrame, origin: Column | None = None) -> DataFrame:
    """Messages whose payload is a JSON array as one message per item, with an id of its own; other messages as they are.

    An item's id is its message's, then ``origin`` where that is given, then its place in the list. Lists with the same id and origin are told apart by a number after the origin."""
    many = messages.where(is_list(F.col("payload")))
    if origin is not None:
        many = many.withColumn("_origin", origin)
        others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in messages.columns]))
        many = many.withColumn("_nth", F.row_number().over(Window.partitionBy("id", "_origin").orderBy(others)))
        many = many.withColumn("_origin", F.when(F.col("_nth") == 1, F.col("_origin")).otherwise(F.concat_ws(".", "_origin", F.col("_nth").cast("string"))))
    many = many.withColumn("_items", F.from_json("payload", "array<string>")).select("*", F.posexplode("_items").alias("_pos", "_item"))
    id_ = F.concat_ws("-", "id", *([] if origin is None else ["_origin"]), F.col("_pos").cast("string"))
    items = many.select(*[id_.alias(c) if c == "id" else F.col("_item").alias(c) if c == "payload" else F.col(f"`{c}`") for c in messages.columns])
    return messages.where(~is_list(F.col("payload"))).unionByName(items)


@dataclass
class Transformer:
    """``apply`` takes and returns message tables; a row it returns with a non-null ``error`` column is a dead letter, a null payload is dropped. One that
    fails as a whole makes dead letters of all it was given."""

    name: str
    apply: Callable[[DataFrame], DataFrame]


@dataclass
class Publisher:
    """``write`` stores messages; with ``by_batch`` it is also given the batch's number, so that it can replace what an earlier try of the batch has written."""

    name: str
    write: Callable[..., None] | None = None
    by_batch: bool = False


@dataclass
class ExchangeResult:
    """published has target, deadletters stage, target and error, unrouted the inputs that no transformer took."""

    published: DataFrame
    deadletters: DataFrame
    unrouted: DataFrame


@dataclass
class Exchange:
    """Inputs go to the transformers that ``inbound`` routes name (all of them without routes), outputs to the publishers of ``outbound`` likewise.

    A list payload becomes one message per item, which goes straight to the publishers; a single payload is published and offered to the
    transformers again, up to ``max_hops`` times. What would go on after that is a dead letter of stage ``hops``.

    Every hop is written once, by transformer, in the shared folder and read back: a transformer reads its own messages only, the input is read once, and plans don't grow with hops.
    """

    name: str
    transformers: list[Transformer] = field(default_factory=list)
    publishers: list[Publisher] = field(default_factory=list)
    inbound: DataFrame | None = None
    outbound: DataFrame | None = None
    components: DataFrame | None = None
    max_hops: int = 5

    def _dealt(self, messages: DataFrame, routes: DataFrame | None, names: list[str]) -> DataFrame:
        """``messages`` once for each of ``names`` they go to, with target; those that go nowhere once, with a null target. Switches count where there are routes."""
        if routes is None:
            found = F.array(*map(F.lit, names)).cast("array<string>")
        else:
            on = names
            if self.components is not None:
                switches = self.components.where((F.col("exchange") == self.name) & F.col("name").isin(names))
                off = {r["name"] for r in switches.groupBy("name").agg(F.min(F.coalesce("is_active", F.lit(True))).alias("on")).where("not on").collect()}
                on = [n for n in names if n not in off]
            messages = _targets(messages, routes)
            found = F.array_intersect("_targets", F.array(*map(F.lit, on)).cast("array<string>"))
        return messages.withColumn("target", F.explode_outer(found)).select(*ENVELOPE, "target")

    def _hop(self, routed: DataFrame, hop: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
        """Singles, items of lists and dead letters that the transformers make of ``routed``, each transformer's written by itself: if one fails the others go on."""
        singles, items, dead = [], [], []
        letter = lambda df, name, error: df.select(*ENVELOPE, F.lit("transform").alias("stage"), F.lit(name).alias("target"), error.cast("string").alias("error"))
        for t in self.transformers:
            given = routed.where(F.col("target") == t.name).drop("target")
            try:
                out = t.apply(given)
                error = F.col("error").cast("string") if "error" in out.columns else F.lit(None).cast("string")
                made = out.select(*ENVELOPE, error.alias("error")).where("error is not null or payload is not null")
                kind = F.when(F.col("error").isNotNull(), "dead").when(is_list(F.col("payload")), "list").otherwise("single")
                made = staged(made.withColumn("kind", kind), by="kind")
            except Exception as failure:  # noqa: BLE001 - any failure of a transformer is that transformer's dead letter
                dead.append(letter(given, t.name, F.lit(str(failure))))
                continue
            singles.append(made.where("kind = 'single'").select(*ENVELOPE))
            items.append(explode_lists(made.where("kind = 'list'").select(*ENVELOPE), F.lit(f"{hop}.{t.name}")))
            dead.append(letter(made.where("kind = 'dead'"), t.name, F.col("error")))
        return singles, items, dead

    def run(self, messages: DataFrame, whole: bool = False) -> ExchangeResult:
        """The whole exchange over a table. Only tables in the shared folder are written, the first of which takes the messages as they are, those without id apart; messages that are
        ``whole``, as :func:`envelope` gives them, are taken straight to the transformers."""
        inputs = messages.select(*ENVELOPE)
        if not whole:
            given = staged(inputs.withColumn("idless", F.col("id").isNull()), by="idless")
            inputs = given.where("not idless").select(*ENVELOPE).withColumn("correlation_id", F.coalesce("correlation_id", "id")).unionByName(envelope(given.where("idless").select(*ENVELOPE)))
        names = [p.name for p in self.publishers]
        none = lambda *more: inputs.limit(0).select(*ENVELOPE, *[F.lit("").alias(c) for c in more])
        if not self.transformers:
            return ExchangeResult(self._dealt(inputs, self.outbound, names).where("target is not null"), none("stage", "target", "error"), none())
        transformers = [t.name for t in self.transformers]
        routed = staged(self._dealt(inputs, self.inbound, transformers), by="target")
        left, done, dead, hop = routed.where("target is null").select(*ENVELOPE), [], [], 1
        while True:
            singles, items, failed = self._hop(routed, hop)
            done, dead = done + singles + items, dead + failed
            if self.inbound is None or not singles:
                break
            again = self._dealt(reduce(DataFrame.unionByName, singles), self.inbound, transformers).where("target is not null")
            if hop >= self.max_hops:
                dead.append(again.select(*ENVELOPE, F.lit("hops").alias("stage"), "target", F.lit(f"stopped after {hop} hops").alias("error")))
                break
            routed, hop = staged(again, by="target"), hop + 1
            if routed.isEmpty():
                break
        union = lambda dfs, *more: reduce(DataFrame.unionByName, dfs) if dfs else none(*more)
        return ExchangeResult(self._dealt(union(done), self.outbound, names).where("target is not null"), union(dead, "stage", "target", "error"), left)

    def publish(self, result: ExchangeResult, deadletter: Callable[..., None], batch_id: int | None = None) -> None:
        """Write each publisher's rows: all are dealt out in one pass, and a publisher reads its own. One that fails sends its rows to ``deadletter`` with its error, the others go on.
        All dead letters are written at once, with the batch's number where one is given."""
        published = staged(result.published, by="target")
        dead = [result.deadletters.select(*ENVELOPE, "stage", "target", "error")]
        for p in self.publishers:
            rows = published.where(F.col("target") == p.name)
            try:
                if p.write:
                    p.write(rows.drop("target"), *([batch_id] if p.by_batch else []))
            except Exception as error:  # noqa: BLE001 - any failure of a sink is that sink's dead letter
                dead.append(rows.select(*ENVELOPE, F.lit("publish").alias("stage"), "target", F.lit(str(error)).alias("error")))
        deadletter(reduce(DataFrame.unionByName, dead), *([] if batch_id is None else [batch_id]))


def exchange_from_config(spark: SparkSession, config: dict, transformers: dict[str, Callable[[DataFrame], DataFrame]], writers: dict[str, Callable[[DataFrame], None]]) -> Exchange:
    """An exchange from its description: Name, DataIn (at least one), Transformers, DataOut, each with Name, and Filters of Kind, Match and Target.

    Names listed twice count once; an unknown transformer or sink is an error.
    """
    if not config.get("DataIn"):
        raise ValueError("an exchange needs an input")
    names = lambda key: list(dict.fromkeys(x["Name"] for x in config.get(key, [])))
    missing = [n for n in names("Transformers") if n not in transformers] + [n for n in names("DataOut") if n not in writers]
    if missing:
        raise ValueError(f"unknown components: {missing}")
    rules = [Route(f["Kind"], f.get("Match", ""), f["Target"]) for f in config.get("Filters", [])]
    t, p = names("Transformers"), names("DataOut")
    table = lambda targets: routes_table(spark, chosen) if (chosen := [r for r in rules if r.target in targets]) else None
    return Exchange(config["Name"], [Transformer(n, transformers[n]) for n in t], [Publisher(n, writers[n]) for n in p], table(t), table(p), max_hops=config.get("MaxHops", 5))


def outstanding(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Stored messages that no step has finished."""
    return messages.join(done.select("id"), "id", "left_anti")


def with_outstanding(stored: DataFrame, done: DataFrame, new: DataFrame) -> DataFrame:
    """What a start works on: outstanding messages first (is_new false), then new ones; a stored id isn't taken twice."""
    old = outstanding(stored, done)
    return old.withColumn("is_new", F.lit(False)).unionByName(new.join(stored.select("id"), "id", "left_anti").withColumn("is_new", F.lit(True)))


def replay_deadletters(deadletters: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(republish, keep, drop): requests and uris without a response by their uri are published again (and leave the table); those with one, and other types, are dropped.

    A CrawlUri needs a base uri to be published again, else it is kept.
    """
    typed = deadletters.withColumn("uri", uri_of(F.col("payload")))
    known = typed.where("payload_type in ('CrawlRequest', 'CrawlUri')")
    answered = responses.select("uri").distinct()
    done = known.join(answered, "uri", "left_semi")
    open_ = known.join(answered, "uri", "left_anti")
    base = F.coalesce(F.get_json_object("payload", "$.base_uri[0]"), F.get_json_object("payload", "$.base_uri"))
    whole = (F.col("payload_type") == "CrawlRequest") | base.isNotNull()
    other = typed.where("payload_type is null or payload_type not in ('CrawlRequest', 'CrawlUri')")
    columns = deadletters.columns
    return open_.where(whole).select(*columns), open_.where(~whole).select(*columns), done.select(*columns).unionByName(other.select(*columns))
