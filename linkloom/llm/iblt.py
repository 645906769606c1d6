"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text is a multiset of paragraphs: pieces of four to nine words of a line, cut after words that end alike. Every distinct paragraph (with how often it occurs) has a
64-bit digest whose low 16 bits check the others. A sketch has groups of 3 x 32 cells; a digest goes to one group and there to one
cell in each third, where digests are counted and xor-ed. Two sketches subtract cell by cell, so that what both texts hold cancels;
peeling takes the cells that hold a single digest, removes it from its other cells and goes on until the differing
digests are all found. Where that fails, both texts are sketched again with more groups, and where that fails too the digests
themselves are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: A paragraph is a piece of a line: three to eight words and one that ends in s, n or a mark, or else nine words or what is left of the line. Cuts
#: follow from the words nearby, so that they fall into place again after an edit.
PARAGRAPH = r"[^\S\n]*+(?:(?:\S++[^\S\n]*+){3,8}?\S*[sn.!?](?!\S)[^\S\n]*+|(?:\S++[^\S\n]*+){1,9})"
SIDE = 32  # cells in a third of a group
ROUNDS = 12
LOAD = 40  # digests that a group is meant for when a sketch is made larger
RETRIES = 2  # there are bits for three placements of a digest
MOST = 256  # digests of both texts for a retry, whose work grows with their square; more are compared themselves, with the same result


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digest(paragraph: Column, times: Column) -> Column:
    high = F.xxhash64(paragraph, times).bitwiseAND(F.lit(-65536).cast("long"))
    return let(high, lambda h: h.bitwiseOR(F.xxhash64(h).bitwiseAND(F.lit(65535).cast("long"))))


def _valid(key: Column) -> Column:
    return F.xxhash64(key.bitwiseAND(F.lit(-65536).cast("long"))).bitwiseAND(F.lit(65535).cast("long")) == key.bitwiseAND(F.lit(65535).cast("long"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.length(F.trim(p)) > 0)


def digests(text: Column) -> Column:
    """The digests of a text's paragraphs, array<long>; none for an empty text."""

    def counted(ps):  # in order, so that equal ones are neighbours
        first = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: (i == 1) | (F.element_at(ps, i) != F.element_at(ps, F.greatest(i - 1, F.lit(1)))))
        each = let(first, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ps) + 1)), lambda i, j: _digest(F.element_at(ps, i), j - i)))
        return F.when(F.size(ps) == 0, F.array().cast("array<bigint>")).otherwise(each)

    return let(F.array_sort(paragraphs(text)), counted)


def _hits(key: Column, cell: Column, third: int, retry: int) -> Column:
    """Whether a digest's cell in a third is ``cell``: five bits of the digest, others on a retry."""
    return F.shiftright(key, 16 + 15 * retry + 5 * third).bitwiseAND(F.lit(SIDE - 1).cast("long")) == cell


def _filled(keys: Column, retry: int) -> Column:
    """The 96 cells of one group."""
    fold = lambda xs: F.struct(F.size(xs).alias("n"), F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)).alias("k"))

    def third(t: int) -> Column:  # keys are dealt by the upper bits of their cell first, so that each is looked at 12 times instead of 32
        place = lambda x: F.shiftright(x, 16 + 15 * retry + 5 * t).bitwiseAND(F.lit(SIDE - 1).cast("long"))
        cells = lambda h, some: F.transform(F.sequence(h * 8, h * 8 + 7), lambda c: let(F.filter(some, lambda x: place(x) == c), fold))
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SIDE // 8 - 1).cast("long")), lambda h: let(F.filter(keys, lambda x: F.shiftright(place(x), 3) == h), lambda some: cells(h, some))))

    return F.concat(third(0), third(1), third(2))


def sketch(keys: Column, groups: Column | None = None, retry: int = 0) -> Column:
    """array (groups x 96) of struct<n int, k long>, groups one after another; without ``groups`` one."""
    if groups is None:
        return let(keys, lambda ks: _filled(ks, retry))

    def every(ks):  # bound once: Spark may put whole expressions where a column's name stands, also inside of loops
        mine = lambda g: F.filter(ks, lambda x: F.pmod(F.xxhash64(x, F.lit(retry)), groups) == g)
        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), groups - 1), lambda g: let(mine(g), lambda xs: _filled(xs, retry))))

    return let(keys, every)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k")))


def peel(difference: Column, groups: Column | None = None, retry: int = 0) -> Column:
    """struct<ok, found array<struct<k, n>>> of a difference of sketches: each differing digest, n = 1 if the first text has it, -1 if the second."""

    def one_group(cells):
        found = F.array().cast("array<struct<k:bigint,n:int>>")
        begin = F.struct(cells.alias("cells"), found.alias("found"))

        def turn(state, _):
            pure = F.array_distinct(F.transform(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & _valid(c["k"])), lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

            def removed(ps):
                def third(t: int) -> Column:
                    def clean(c, i):
                        less = lambda gs: F.struct(F.aggregate(gs, c["n"], lambda a, q: a - q["n"]).alias("n"), F.aggregate(gs, c["k"], lambda a, q: a.bitwiseXOR(q["k"])).alias("k"))
                        return let(F.filter(ps, lambda q: _hits(q["k"], i.cast("long"), t, retry)), lambda gs: F.when(F.size(gs) == 0, c).otherwise(less(gs)))

                    return F.transform(F.slice(state["cells"], t * SIDE + 1, SIDE), clean)

                left = F.concat(third(0), third(1), third(2))
                return F.when(F.size(ps) == 0, state).otherwise(F.struct(left.alias("cells"), F.concat(state["found"], ps).alias("found")))

            return let(pure, removed)

        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn)
        return let(end, lambda s: F.struct((~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0))).alias("ok"), s["found"].alias("found")))

    if groups is None:
        return one_group(difference)
    start = lambda g: g.cast("int") * (3 * SIDE) + 1
    each = let(difference, lambda d: F.transform(F.sequence(F.lit(0).cast("long"), groups - 1), lambda g: one_group(F.slice(d, start(g), 3 * SIDE))))
    return let(each, lambda xs: F.struct(F.forall(xs, lambda x: x["ok"]).alias("ok"), F.flatten(F.transform(xs, lambda x: x["found"])).alias("found")))


def with_difference(rows: DataFrame, name: str, a: str, b: str, sketch_a: str, sketch_b: str) -> DataFrame:
    """``rows`` with ``name``, struct<ok, found>: the digests that only one of the digest arrays ``a`` and ``b`` has, peeled from their
    sketches of one group (texts that share no digest differ in all of them, which needs no peeling), where that fails from larger ones: a group for every ``LOAD`` digests, then twice as many. What still fails is the difference of the arrays, so ok is always true."""
    only = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))
    exact = F.struct(F.lit(True).alias("ok"), F.concat(only(a, b, 1), only(b, a, -1)).alias("found"))
    rows = rows.withColumn(name, F.when(F.arrays_overlap(a, b), peel(subtract(F.col(sketch_a), F.col(sketch_b)))).otherwise(exact))
    for retry in range(1, RETRIES + 1):
        groups = F.greatest(F.lit(2).cast("long"), F.ceil((F.size(a) + F.size(b)) * F.lit(2 ** (retry - 1)) / F.lit(LOAD)))
        rows = rows.withColumn("_groups", groups).withColumn("_cells", F.when(~F.col(name)["ok"] & (F.size(a) + F.size(b) <= MOST), subtract(sketch(F.col(a), F.col("_groups"), retry), sketch(F.col(b), F.col("_groups"), retry))))
        rows = rows.withColumn(name, F.when(F.col(name)["ok"] | F.col("_cells").isNull(), F.col(name)).otherwise(peel(F.col("_cells"), F.col("_groups"), retry))).drop("_groups", "_cells")
    return rows.withColumn(name, F.when(F.col(name)["ok"], F.col(name)).otherwise(exact))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Shared digests of all that both have, from the differing ones: 1 for equal texts (two empty ones too), 0 for nothing in common."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - F.size(found) / total)


def as_text(cells: Column) -> Column:
    """A sketch as a string: count and xor of every cell in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.hex(c["n"].cast("long")), F.lit("."), F.hex(c["k"]))), ",")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, d, next_text, next_d: text and digests, and those of the next row by descending doc_id, after the last of the first; nulls are empty.

    Rows are dealt into ranges of doc_id, and the first row of the next range is copied to the end of each: no task sees more than a range. Rows of
    equal doc_id follow each other by text; a null doc_id comes last. A single row is its own next.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("d", digests(F.col("text")))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [i / parts for i in range(1, parts)] or [0.5]
    ends = docs.select("doc_id").agg(F.percentile_approx("doc_id", points, 10000).alias("cuts"), F.max("doc_id").alias("top"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    cuts = sorted(set(ends["cuts"] or []) - {ends["top"]})
    # Range r holds the ids over cuts[r-1], up to cuts[r]; null ids are in range -1.
    cut = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    home = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(cut, lambda c: c < F.col("doc_id"))))
    lowest = -1 if ends["known"] < ends["n"] else 0
    also = (
        F.when(F.col("doc_id") == F.lit(ends["top"]), F.lit(lowest))  # the first row follows the last
        .when(F.array_contains(cut, F.col("doc_id")), F.size(F.filter(cut, lambda c: c < F.col("doc_id"))) + 1)
    )
    rows = docs.withColumn("_home", home).withColumn("_also", also)
    guests = rows.where("_also is not null").withColumn("_range", F.col("_also")).withColumn("_guest", F.lit(True))
    if lowest < 0:
        guests = guests.unionByName(rows.where("doc_id is null").withColumn("_range", F.lit(0)).withColumn("_guest", F.lit(True)))
    all_ = rows.withColumn("_range", F.col("_home")).withColumn("_guest", F.lit(False)).unionByName(guests)
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "text")
    next_ = F.lead(F.struct("text", "d")).over(order)
    return all_.withColumn("_next", next_).where("not _guest").select("doc_id", "text", "d", F.coalesce("_next.text", "text").alias("next_text"), F.coalesce("_next.d", "d").alias("next_d"))


def fingerprint_versions(pairs: DataFrame) -> DataFrame:
    """doc_id, text, edited, fingerprint, edited_fingerprint, edit_digests, near_edited, near_next for rows of doc_id, text, d (its digests), edited, next_d.

    edit_digests are the peeled digests that differ between the versions (n = 1: only in text). An empty text has an empty sketch.
    """
    rows = pairs.select("doc_id", "text", "edited", "d", digests(F.col("edited")).alias("de"), F.col("next_d").alias("dn"))
    rows = rows.select("*", sketch(F.col("d")).alias("s"), sketch(F.col("de")).alias("se"), F.when(F.arrays_overlap("d", "dn"), sketch(F.col("dn"))).alias("sn"))
    rows = with_difference(with_difference(rows, "xe", "d", "de", "s", "se"), "xn", "d", "dn", "s", "sn")
    return rows.select(
        "doc_id",
        "text",
        "edited",
        as_text(F.col("s")).alias("fingerprint"),
        as_text(F.col("se")).alias("edited_fingerprint"),
        F.col("xe.found").alias("edit_digests"),
        likeness(F.col("d"), F.col("de"), F.col("xe.found")).alias("near_edited"),
        likeness(F.col("d"), F.col("dn"), F.col("xn.found")).alias("near_next"),
    )


def edited_by_next(docs: DataFrame) -> DataFrame:
    """:func:`with_next` and edited: the last third of the code points gives way to the first as many (or all) of the next document."""
    rows = with_next(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)))
