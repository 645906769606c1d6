"""Document parts from node tables: texts, meta, links, files, tables, articles, anomalies.

Every builder takes nodes and selected nodes and gives flat rows keyed by page_id; ``ord`` is the place within a page and slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import resolve_uri
from ..schemas import PART_CODES
from ..sources.staged import staged
from .selectors import Selector, compile_definitions, compile_xpath, inside_any, node_lines, select_by_definition, select_nodes

MAX_PARTS = 5000

LINKS = Selector("link", "//a")
FILES = Selector("file", "//*[self::a or self::img]")
TABLES = Selector("table", "//table")
META = Selector("meta", "//meta")
TITLE, CONTENT = Selector("title", "//title"), Selector("content", "//body")


def _ordered(value: Column, by: str = "pre") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("_o"), value.alias("_v")))), lambda x: x["_v"])


def _lines_joined(selected: DataFrame, line: Column) -> DataFrame:
    return selected.groupBy("page_id", "slot").agg(F.array_join(F.transform(_ordered(line), lambda x: F.concat(x, F.lit("\n"))), "").alias("text"))


def extract_text(nodes: DataFrame, selector: Selector) -> DataFrame:
    """(page_id, slot, text): the text of every selected node on a line of its own. Pages without a selected node have no row."""
    return _lines_joined(node_lines(nodes, select_nodes(nodes, [selector])), F.col("line"))


def extract_meta(nodes: DataFrame, selector: Selector = META) -> DataFrame:
    """(page_id, slot, text): the ``content`` attribute of every selected node on a line of its own, an empty line where it is missing."""
    return _lines_joined(select_nodes(nodes, [selector]), F.coalesce(F.element_at("attrs", F.lit("content")), F.lit("")))


def with_base(nodes: DataFrame, pages: DataFrame | None) -> DataFrame:
    """base_uri from ``pages``; without them, from what the pages were read with (see :func:`~linkloom.operators.selectors.node_lines`)."""
    return nodes if pages is None else nodes.drop("base_uri").join(pages.select("page_id", F.col("url").alias("base_uri")), "page_id")


def extract_links(nodes: DataFrame, pages: DataFrame | None = None, selector: Selector = LINKS) -> DataFrame:
    """(page_id, ord, text, uri, base_uri): anchors with ``href`` in page order, below or at the selected nodes; ord 0 is the head, the others hang on it."""
    anchors = inside_any(nodes.where("tag = 'a' and element_at(attrs, 'href') is not null"), select_nodes(nodes, [selector]), "page_id")
    rows = with_base(node_lines(nodes, anchors), pages)
    order = Window.partitionBy("page_id").orderBy("pre")
    return rows.select("page_id", (F.row_number().over(order) - 1).alias("ord"), F.col("line").alias("text"), resolve_uri("base_uri", F.element_at("attrs", F.lit("href"))).alias("uri"), "base_uri")


def page_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, pre, href, uri, base_uri) of every anchor with ``href``: no shuffle of texts, for link graphs."""
    anchors = nodes.where("tag = 'a'").select("page_id", "pre", F.element_at("attrs", F.lit("href")).alias("href")).where("href is not null")
    return with_base(anchors, pages).select("page_id", "pre", "href", resolve_uri("base_uri", "href").alias("uri"), "base_uri")


def extract_files(nodes: DataFrame, pages: DataFrame | None = None, selector: Selector = FILES) -> DataFrame:
    """(page_id, ord, tag, text, uri, base_uri, missing): ``src`` of images and ``href`` of anchors among the selected nodes and those inside of them.

    Rows of one uri and text are one, but a row without uri is never merged; missing marks these.
    """
    found = inside_any(nodes.where("tag in ('a', 'img')"), select_nodes(nodes, [selector]), "page_id")
    rows = _file_rows(with_base(node_lines(nodes, found), pages), "page_id")
    order = Window.partitionBy("page_id").orderBy("pre")
    return rows.select("page_id", (F.row_number().over(order) - 1).alias("ord"), "tag", "text", "uri", "base_uri", F.col("uri").isNull().alias("missing"))


def _file_rows(lines: DataFrame, *keys: str) -> DataFrame:
    """One row for each uri and text of ``keys``, all of those without uri: keys, pre, tag, text, uri, base_uri."""
    target = F.element_at("attrs", F.when(F.col("tag") == "img", F.lit("src")).otherwise(F.lit("href")))
    rows = lines.select(*keys, "pre", "tag", F.col("line").alias("text"), resolve_uri("base_uri", target).alias("uri"), "base_uri")
    same = Window.partitionBy(*keys, F.coalesce("uri", F.concat(F.lit("\x00"), F.col("pre").cast("string"))), "text").orderBy("pre")
    return rows.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")


def download_manifest(files: DataFrame | Sequence[DataFrame], config: DataFrame) -> DataFrame:
    """Distinct (page_id, uri, file_name) of the file links of pages whose configuration (page_id, download_content) wants content.

    ``files`` is a table with page_id and uri, or several: of a page's own parts, of its article's content and of its tables' cells.
    """
    from ..functions.urls import file_name

    wanted = config.where("download_content").select("page_id").distinct()
    places = [files] if isinstance(files, DataFrame) else files
    links = reduce(DataFrame.unionByName, [f.select("page_id", "uri") for f in places])
    return links.where("uri is not null").join(wanted, "page_id", "left_semi").distinct().withColumn("file_name", file_name("uri"))


def table_cells(nodes: DataFrame) -> DataFrame:
    """(page_id, table_pre, row_no, col_no, is_header, part_type, text, uri, base_uri) of all tables of a page, a nested table's rows and cells its own; table_pre is the table's place in the page.

    Headers are the ``th`` in row -1; rows are ``tr`` with a ``td`` or without any cell (one cell of nulls). part_type is what the cell holds, uri its first link or image. The reader has noted
    which table and row hold a node, so that all of it is windows over one partitioning by page.
    """
    kinds = nodes.where("tag in ('tr', 'td', 'th') and table_pre is not null").withColumn("_row", F.when(F.col("tag") == "tr", F.col("pre")).otherwise(F.col("row_pre")))
    row, count = Window.partitionBy("page_id", "_row"), lambda tag: F.count(F.when(F.col("tag") == tag, 1))
    told = kinds.withColumns({"_td": count("td").over(row), "_th": count("th").over(row), "_table": F.max(F.when(F.col("tag") == "tr", F.col("table_pre"))).over(row)})
    body = F.col("_row").isNotNull() & ((F.col("_td") > 0) | (F.col("_th") == 0))
    told = told.where((F.col("tag") == "th") | body).withColumn("_table", F.when(F.col("tag") == "th", F.col("table_pre")).otherwise(F.col("_table")))
    order, kind = Window.partitionBy("page_id", "_table").orderBy("pre"), Window.partitionBy("page_id", "_table", "tag").orderBy("pre")
    rows_before = F.count(F.when(F.col("tag") == "tr", 1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    head = F.col("tag") == "th"
    column = F.when(head, F.row_number().over(kind)).otherwise(F.row_number().over(Window.partitionBy("page_id", "_row", "tag").orderBy("pre")))
    numbered = told.withColumns({"row_no": F.when(head, F.lit(-1)).otherwise((rows_before - 1).cast("int")), "col_no": column - 1})
    cells = numbered.where("tag != 'tr' or _td = 0")
    lines, full = classify_cells(node_lines(nodes, cells)), F.col("tag") != "tr"
    return lines.select(
        "page_id",
        F.col("_table").alias("table_pre"),
        "row_no",
        F.when(full, F.col("col_no")).otherwise(F.lit(0)).alias("col_no"),
        head.alias("is_header"),
        F.when(full, F.col("part_type")).alias("part_type"),
        F.when(full, F.concat("line", F.lit("\n"))).alias("text"),
        F.when(full, F.col("ref")).alias("uri"),
        "base_uri",
    )


def extract_tables(nodes: DataFrame, pages: DataFrame | None = None, selector: Selector = TABLES) -> DataFrame:
    """(page_id, table_no, row_no, col_no, is_header, part_type, text, uri): cells of every selected table (see :func:`table_cells`), each table in page order."""
    chosen = select_nodes(nodes, [selector]).where("tag = 'table'").select("page_id", F.col("pre").alias("table_pre"))
    chosen = chosen.withColumn("table_no", F.row_number().over(Window.partitionBy("page_id").orderBy("table_pre")) - 1)
    both = with_base(table_cells(nodes), pages).unionByName(chosen, allowMissingColumns=True)
    told = both.withColumn("table_no", F.max("table_no").over(Window.partitionBy("page_id", "table_pre"))).where("row_no is not null and table_no is not null")
    return told.select("page_id", "table_no", "row_no", "col_no", "is_header", "part_type", "text", resolve_uri("base_uri", "uri").alias("uri"))


def classify_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (node columns) with part_type by what they contain: links and images, or either with tables, are an Article; then
    images a File, links a Link, a table itself a Table, anything else Text."""
    a, img, table = (F.col(f"n_{t}") > 0 for t in ("a", "img", "table"))
    return cells.withColumn("part_type", F.when((a & img) | ((a | img) & table), "Article").when(img, "File").when(a, "Link").when(F.col("tag") == "table", "Table").otherwise("Text"))


def table_rows(cells: DataFrame) -> DataFrame:
    """(page_id, table_no, headers array<string>, rows array<array<string>>) of table cells."""
    row = cells.groupBy("page_id", "table_no", "row_no").agg(_ordered(F.col("text"), "col_no").alias("cells"))
    return row.groupBy("page_id", "table_no").agg(
        F.first(F.when(F.col("row_no") < 0, F.col("cells")), ignorenulls=True).alias("headers"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("row_no") >= 0, F.struct("row_no", "cells")))), lambda x: x["cells"]).alias("rows"),
    )


def table_text(cells: DataFrame, *keys: str) -> DataFrame:
    """(page_id, table_no, text): headers each followed by ``. \\n``, then cells each on a line, row by row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    piece = F.when(F.col("is_header"), F.concat(F.regexp_replace(text, r"\n$", ""), F.lit(". \n"))).otherwise(F.concat(F.regexp_replace(text, r"\n$", ""), F.lit("\n")))
    ordered = F.array_sort(F.collect_list(F.struct("row_no", "col_no", piece.alias("piece"))))
    return cells.groupBy("page_id", *keys, "table_no").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


def extract_articles(nodes: DataFrame, title: Selector = TITLE, content: Selector = CONTENT, timestamp: Selector | None = None) -> DataFrame:
    """(page_id, title, content, timestamp) for every page with nodes; null where a selector finds nothing."""
    slots = [s for s in (title, content, timestamp) if s]
    lines = node_lines(nodes, select_nodes(nodes, [Selector(name, s.xpath, s.content_match) for name, s in zip(("title", "content", "timestamp"), slots, strict=False)]))
    text = _lines_joined(lines, F.col("line"))
    wide = text.groupBy("page_id").pivot("slot", ["title", "content", "timestamp"]).agg(F.first("text"))
    return nodes.select("page_id").distinct().join(wide, "page_id", "left")


def autodetect_parts(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, kind_order, ord, part_type, part_code, text, uri): the article (title, body), every table, every link, every image, in that order.

    Of nodes that are dealt out by page (see :func:`~linkloom.sources.staged.clustered`) all kinds are worked out without another exchange."""
    article = extract_articles(nodes).select("page_id", F.lit(0).alias("kind_order"), F.lit(0).alias("ord"), F.lit("Article").alias("part_type"), F.col("title").alias("text"), F.lit(None).cast("string").alias("uri"))
    tables = table_text(extract_tables(nodes, pages)).select("page_id", F.lit(1).alias("kind_order"), F.col("table_no").alias("ord"), F.lit("Table").alias("part_type"), "text", F.lit(None).cast("string").alias("uri"))
    links = extract_links(nodes, pages).select("page_id", F.lit(2).alias("kind_order"), "ord", F.lit("Link").alias("part_type"), "text", "uri")
    images = extract_files(nodes, pages, Selector("file", "//img")).where("tag = 'img'").select("page_id", F.lit(3).alias("kind_order"), "ord", F.lit("File").alias("part_type"), "text", "uri")
    parts = article.unionByName(tables).unionByName(links).unionByName(images)
    codes = F.create_map(*[F.lit(x) for pair in PART_CODES.items() for x in pair])
    return parts.withColumn("part_code", codes[F.col("part_type")])


def flatten_parts(parts: DataFrame, part_type: str | None = None, name: str | None = None, limit: int | None = MAX_PARTS) -> DataFrame:
    """Parts of a type or name, the root included, reached over ``sub`` edges only, in order; of each page the first ``limit`` visited parts, or all (None).

    ``parts``: page_id, part_id, parent_id, edge (``sub`` or another), part_type, name, ord. ord is depth-first, so the guard keeps what a walk would have visited;
    :func:`cut_pages` tells which pages have more.
    """
    rows = _visited(parts)
    if limit is not None:
        rows = rows.where(F.col("_k") <= limit)
    rows = rows.drop("_k")
    if part_type:
        rows = rows.where(F.col("part_type") == part_type)
    return rows.where(F.col("name") == name) if name else rows


def cut_pages(parts: DataFrame, limit: int = MAX_PARTS) -> DataFrame:
    """(page_id, n_parts, n_cut) of the pages of which :func:`flatten_parts` leaves parts out."""
    n = _visited(parts).groupBy("page_id").agg(F.max("_k").cast("long").alias("n_parts"))
    return n.where(F.col("n_parts") > limit).withColumn("n_cut", F.col("n_parts") - limit)


def _visited(parts: DataFrame) -> DataFrame:
    """The parts that a walk over ``sub`` edges reaches, with their number _k in the page's order; each level is written once."""
    reached = frontier = staged(parts.where("parent_id is null").select("page_id", "part_id"))
    while True:
        step = parts.where("edge = 'sub'").join(frontier.withColumnRenamed("part_id", "parent_id"), ["page_id", "parent_id"], "left_semi").select("page_id", "part_id")
        step = staged(step.join(reached, ["page_id", "part_id"], "left_anti"))
        if step.isEmpty():
            break
        reached, frontier = reached.unionByName(step), step
    return parts.join(reached, ["page_id", "part_id"], "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")))


def anomalies(nodes: DataFrame, pages: DataFrame, selectors: Sequence[Selector] = (), files: Selector | None = None, meta: Selector | None = None, timestamp: Selector | None = None, tables: Selector = TABLES) -> DataFrame:
    """(page_id, anomaly_type, part_type, description) for auto-detected parts of pages: missing title, content, links, images' sources, table headers and rows.

    A page without text at one of ``selectors`` lacks text, one without a node at ``files`` file links, one without a node at ``meta`` text, and one without
    a node at an article's ``timestamp`` content. What ``tables`` picks after a page's first must be a table or hold one: else a table is missing.
    """
    describe = lambda anomaly, part, xpath: F.struct(F.lit(anomaly).alias("anomaly_type"), F.lit(part).alias("part_type"), F.lit(f"{anomaly}, Selector: {xpath}").alias("description"))
    texts = select_nodes(nodes, [Selector(str(i), s.xpath, s.content_match) for i, s in enumerate(selectors)]) if selectors else None
    asked = [(TITLE, "MissingTitle", "Article"), (CONTENT, "MissingContent", "Article"), (Selector("", "//a[@href]"), "MissingFileLink", "Link")]
    asked += [(files, "MissingFileLink", "File")] if files else []
    asked += [(meta, "MissingText", "Meta")] if meta else []
    asked += [(timestamp, "MissingContent", "Article")] if timestamp else []
    names = [LINKS.xpath if s.xpath == "//a[@href]" else s.xpath for s, _, _ in asked]
    there = nodes.groupBy("page_id").agg(*[F.max(compile_xpath(s.xpath)).alias(f"_{i}") for i, (s, _, _) in enumerate(asked)])
    held = pages.select("page_id").join(there, "page_id", "left")
    lacking = [F.when(~F.coalesce(F.col(f"_{i}"), F.lit(False)), describe(anomaly, part, names[i])) for i, (_, anomaly, part) in enumerate(asked)]
    if texts is not None:
        filled = node_lines(nodes, texts).where("line != ''").groupBy("page_id").agg(F.collect_set("slot").alias("_slots"))
        held = held.join(filled, "page_id", "left")
        none = F.array().cast("array<string>")
        lacking += [F.when(~F.array_contains(F.coalesce("_slots", none), str(i)), describe("MissingText", "Text", s.xpath)) for i, s in enumerate(selectors)]
    by_page = held.select("page_id", F.explode(F.filter(F.array(*lacking), lambda x: x.isNotNull())).alias("_x"))
    bare = nodes.where("(tag = 'img' and element_at(attrs, 'src') is null) or (tag = 'a' and element_at(attrs, 'href') is null)").select("page_id", describe("MissingImg", "File", FILES.xpath).alias("_x"))

    def empty(holder: str, parts: tuple[str, ...], key: str, what: Column) -> DataFrame:
        """Nodes of ``holder`` with none of ``parts`` for their own."""
        both = nodes.where(F.col("tag").isin(holder, *parts)).select("page_id", F.when(F.col("tag") == holder, F.col("pre")).otherwise(F.col(key)).alias("_key"), (F.col("tag") == holder).alias("_holder"))
        return both.groupBy("page_id", "_key").agg(F.max("_holder").alias("_is"), F.min("_holder").alias("_alone")).where("_is and _alone").select("page_id", what.alias("_x"))

    headless = empty("table", ("th",), "table_pre", describe("MissingHeader", "Table", TABLES.xpath))
    cellless = empty("tr", ("td", "th"), "row_pre", describe("MissingRow", "Row", ".//td"))
    extra = select_nodes(nodes, [tables]).withColumn("_k", F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))).where("_k > 1 and tag != 'table' and n_table = 0")
    out = by_page
    for more in (bare, headless, cellless, extra.select("page_id", describe("MissingTable", "Table", tables.xpath).alias("_x"))):
        out = out.unionByName(more)
    return out.select("page_id", "_x.anomaly_type", "_x.part_type", "_x.description")


def anomaly_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("anomaly_type").agg(F.count("*").alias("n"))


#: A site's document definition: parts as rows. edge says how a part hangs on its parent: sub, or title, content or timestamp of an article.
DEFINITION = "config_id string, part_id string, parent_id string, edge string, part_type string, name string, xpath string, content_match string"
DEFAULT_XPATHS = {"Link": LINKS.xpath, "File": FILES.xpath, "Table": TABLES.xpath, "Meta": META.xpath}


def _scopes(definitions: DataFrame) -> DataFrame:
    """``definitions`` with scope, the nearest part above that is an article's content (its parts are sought inside of what it picks), and level, how many such parts are above. One step a level of nesting."""
    rows = staged(definitions)
    up = rows.select("config_id", F.col("part_id").alias("_part"), F.col("parent_id").alias("_up"), (F.col("edge") == "content").alias("_content"))
    walk = rows.select("config_id", "part_id", F.col("parent_id").alias("_at"), F.lit(None).cast("string").alias("scope"), F.lit(0).alias("level"))
    done = None
    while True:
        walk = staged(walk)
        ended = walk.where("_at is null")
        done = ended if done is None else done.unionByName(ended)
        if walk.where("_at is not null").isEmpty():
            break
        step = walk.where("_at is not null").join(up, (walk["config_id"] == up["config_id"]) & (F.col("_at") == F.col("_part")), "left").drop(up["config_id"])
        content = F.coalesce("_content", F.lit(False))
        walk = step.select("config_id", "part_id", F.col("_up").alias("_at"), F.coalesce("scope", F.when(content, F.col("_part"))).alias("scope"), (F.col("level") + content.cast("int")).alias("level"))
    return rows.join(done.drop("_at"), ["config_id", "part_id"])


def defined_parts(nodes: DataFrame, sites: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, rejects): the parts of every page by its own site's definition, all sites in one pass.

    ``sites`` has page_id and config_id, ``definitions`` is of :data:`DEFINITION`. parts: page_id, part_id, parent_id, edge, part_type, name, ord, text, uri, missing. A Text has the lines of all its nodes, a Meta their contents,
    a Link a row for each anchor, a File for each file (missing where it has no target), a Table for each selected table; an Article, a row of its own, has its title's text; an AutoDetect has the rows of :func:`autodetect_parts`.
    A part that finds nothing has one row, missing. rejects are parts whose xpath can't be read, with error.
    """
    defaults = F.create_map(*[F.lit(x) for pair in DEFAULT_XPATHS.items() for x in pair])
    definitions = definitions.withColumn("xpath", F.coalesce("xpath", F.try_element_at(defaults, F.col("part_type"))))
    compiled, rejects = compile_definitions(definitions)
    compiled = staged(_scopes(compiled))
    plans = compiled.groupBy("config_id").agg(F.collect_list(F.struct("part_id", "parent_id", "edge", "part_type", "name", "content_match", "tests", "scope", "level")).alias("_parts"))
    wanted = staged(sites.select("page_id", "config_id").join(plans, "config_id").select("page_id", "_parts"))
    # A row for each part of every page, from files that equal parts make far smaller: Spark is kept from sending it, or some of its columns, everywhere.
    every = wanted.select("page_id", F.explode("_parts").alias("_p")).select("page_id", "_p.part_id", "_p.parent_id", "_p.edge", "_p.part_type", "_p.name", "_p.scope", "_p.level").hint("merge")
    picked, level = None, 0
    for level in range((compiled.agg(F.max("level")).first()[0] or 0) + 1):
        here = select_by_definition(nodes, wanted.select("page_id", F.filter("_parts", lambda p: (p["level"] == level) & (p["part_type"].isin("Text", "Meta", "Link", "File", "Table") | (p["edge"] == "content")) & (p["part_type"] != "AutoDetect")).alias("selectors")))
        if level:
            scoped = here.join(every.select("page_id", "part_id", "scope"), ["page_id", "part_id"])
            here = inside_any(scoped, picked.withColumnRenamed("part_id", "scope"), "page_id", "scope").select(*here.columns)
        here = staged(here)
        picked = here if picked is None else picked.unionByName(here)
    kinds = every.select("page_id", "part_id", "part_type")
    typed = picked.join(kinds, ["page_id", "part_id"])
    lines = node_lines(nodes, typed)
    joined = lambda df, value: df.groupBy("page_id", "part_id").agg(F.array_join(F.transform(_ordered(value), lambda x: F.concat(x, F.lit("\n"))), "").alias("text")).withColumns({"ord": F.lit(0), "uri": F.lit(None).cast("string"), "missing": F.col("text").rlike(r"^\n*$")})
    found = joined(lines.where("part_type = 'Text'"), F.col("line")).unionByName(joined(lines.where("part_type = 'Meta'"), F.coalesce(F.element_at("attrs", F.lit("content")), F.lit(""))).withColumn("missing", F.lit(False)))
    spans = lambda kind: typed.where(F.col("part_type") == kind).select("page_id", "part_id", "pre", "last")
    points = lambda kind, test: nodes.where(test).join(every.where(F.col("part_type") == kind).select("page_id", "part_id"), "page_id")
    order = Window.partitionBy("page_id", "part_id").orderBy("pre")
    anchors = node_lines(nodes, inside_any(points("Link", "tag = 'a' and element_at(attrs, 'href') is not null"), spans("Link"), "page_id", "part_id"))
    found = found.unionByName(anchors.select("page_id", "part_id", F.col("line").alias("text"), (F.row_number().over(order) - 1).alias("ord"), resolve_uri("base_uri", F.element_at("attrs", F.lit("href"))).alias("uri"), F.lit(False).alias("missing")))
    files = _file_rows(node_lines(nodes, inside_any(points("File", "tag in ('a', 'img')"), spans("File"), "page_id", "part_id")), "page_id", "part_id")
    found = found.unionByName(files.select("page_id", "part_id", "text", (F.row_number().over(order) - 1).alias("ord"), "uri", F.col("uri").isNull().alias("missing")))
    chosen = typed.where("part_type = 'Table' and tag = 'table'").select("page_id", "part_id", F.col("pre").alias("table_pre"), (F.row_number().over(order) - 1).alias("table_no"))
    cells = table_cells(nodes).join(chosen, ["page_id", "table_pre"])
    found = found.unionByName(table_text(cells, "part_id").select("page_id", "part_id", "text", F.col("table_no").alias("ord"), F.lit(None).cast("string").alias("uri"), F.lit(False).alias("missing")))
    titles = every.where("edge = 'title'").select("page_id", F.col("parent_id").alias("_article"), "part_id").join(found.select("page_id", "part_id", "text"), ["page_id", "part_id"])
    titles = titles.groupBy("page_id", F.col("_article").alias("part_id")).agg(F.max("text").alias("text"))
    articles = every.where("part_type = 'Article'").select("page_id", "part_id").join(titles, ["page_id", "part_id"], "left")
    found = found.unionByName(articles.select("page_id", "part_id", "text", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("uri"), F.lit(False).alias("missing")))
    detecting = every.where("part_type = 'AutoDetect'").select("page_id", "part_id")
    detected = autodetect_parts(nodes).withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("kind_order", "ord")) - 1)
    detected = detected.join(detecting, "page_id").select("page_id", "part_id", "text", "ord", "uri", F.lit(False).alias("missing"), F.col("part_type").alias("_kind"))
    found = found.withColumn("_kind", F.lit(None).cast("string")).unionByName(detected)
    parts = every.join(found, ["page_id", "part_id"], "left")
    return parts.select("page_id", "part_id", "parent_id", "edge", F.coalesce("_kind", "part_type").alias("part_type"), "name", F.coalesce("ord", F.lit(0)).alias("ord"), "text", "uri", F.coalesce("missing", F.lit(True)).alias("missing")), rejects


def definition_anomalies(parts: DataFrame) -> DataFrame:
    """(page_id, anomaly_type, part_type, part_id) of :func:`defined_parts`: what a part should have found and didn't, by its kind and by its place in an article."""
    nothing = F.col("missing")
    own = F.when(F.col("part_type").isin("Text", "Meta"), "MissingText").when(F.col("part_type") == "Link", "MissingFileLink").when(F.col("part_type") == "File", F.when(F.col("text").isNull(), "MissingFileLink").otherwise("MissingImg")).when(F.col("part_type") == "Table", "MissingTable")
    placed = F.when(F.col("edge") == "title", "MissingTitle").when(F.col("edge").isin("content", "timestamp"), "MissingContent")
    return parts.where(nothing).select("page_id", F.coalesce(placed, own).alias("anomaly_type"), "part_type", "part_id").where("anomaly_type is not null")


def crawl_responses(pages: DataFrame, nodes: DataFrame, sites: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per page of ``sites``, as a crawl step leaves it: page_id, uri, config_id, parts (an array in the order of part_id and ord), title, n_links, n_anomalies, should_index, raw.

    ``sites`` has page_id, config_id, provide_raw and should_index; raw is the page where it is wanted. What is read of a page is what its site's definition names. Pages without nodes have parts that are all missing;
    those whose site has no definition have none.
    """
    found, _ = defined_parts(nodes, sites, definitions)
    found = staged(found)
    part = F.struct("part_id", "ord", "part_type", "name", "text", "uri", "missing")
    by_page = found.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count(F.when((F.col("part_type") == "Link") & ~F.col("missing"), 1)).alias("n_links"), F.min(F.when((F.col("part_type") == "Article") & F.col("text").isNotNull(), F.struct("part_id", "ord", "text")))["text"].alias("title"))
    odd = definition_anomalies(found).groupBy("page_id").agg(F.count("*").alias("n_anomalies"))
    out = pages.select("page_id", F.col("url").alias("uri"), "html").join(sites.select("page_id", "config_id", "provide_raw", "should_index"), "page_id")
    for more in (by_page, odd):
        out = out.join(more, "page_id", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    none = F.array().cast(found.select(F.array(part).alias("p")).schema["p"].dataType)
    return out.select(
        "page_id",
        "uri",
        "config_id",
        F.coalesce("parts", none).alias("parts"),
        "title",
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_anomalies", zero).alias("n_anomalies"),
        F.coalesce("should_index", no).alias("should_index"),
        F.when(F.coalesce("provide_raw", no), F.col("html")).alias("raw"),
    )


def page_manifest(nodes: DataFrame, parts: DataFrame, config: DataFrame) -> DataFrame:
    """The download manifest of pages in one call: the files among their ``parts`` (:func:`defined_parts`, an article's content included) and those in the cells of their tables."""
    own = parts.where("part_type = 'File' and uri is not null").select("page_id", "uri")
    tabled = parts.where("part_type = 'Table'").select("page_id").distinct()
    in_cells = node_lines(nodes, nodes.where("tag in ('a', 'img') and row_pre is not null").join(tabled, "page_id", "left_semi"))
    cells = _file_rows(in_cells, "page_id").select("page_id", "uri")
    return download_manifest([own, cells], config)
