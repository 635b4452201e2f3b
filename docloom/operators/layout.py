"""Ordered and spatial operators: heading segmentation and first-match overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_segments(docs: DataFrame, lines: Column, is_heading: Callable[[Column], Column], *, doc: str = "doc_id", first_title: str = "Overview") -> DataFrame:
    """Sections of each document: ``doc, index, title, content``; ``lines`` is its array of lines.

    Lines belong to the last heading before them, lines before any heading to
    ``first_title``. Of consecutive headings the last counts, one without lines
    after it makes no section. A document is cut within its row: no shuffle, and
    every line is copied once.
    """
    marked = docs.select(doc, lines.alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
    cut = marked.withColumn("_starts", F.concat(F.array(F.lit(-1)), heads, F.array(F.size("_lines"))))
    pair = F.transform(F.sequence(F.lit(0), F.size("_starts") - 2), lambda k: F.struct(F.get("_starts", k).alias("a"), F.get("_starts", k + 1).alias("z")))
    filled = F.filter(pair, lambda p: p["z"] - p["a"] > 1)
    sections = F.transform(filled, lambda p: F.struct(
        F.when(p["a"] < 0, F.lit(first_title)).otherwise(F.get("_lines", p["a"])).alias("title"),
        F.array_join(F.slice("_lines", p["a"] + 2, p["z"] - p["a"] - 1), "\n").alias("content"),
    ))
    return cut.select(doc, F.posexplode(sections).alias("_i", "_s")).select(doc, (F.col("_i") + 1).alias("index"), "_s.title", "_s.content")


def overlaps(one, other):
    """Whether two boxes (x0, y0, x1, y1) share area; of numbers or of columns."""
    return (one[0] < other[2]) & (one[2] > other[0]) & (one[1] < other[3]) & (one[3] > other[1])


def page_text(blocks: list[tuple], tables: list[tuple]) -> str:
    """One page in reading order, from (box, text) blocks and (box, shown) tables.

    As in the operators below, a block belongs to the first table it overlaps, a
    table stands where its first block stood, and tables without blocks follow at the
    end. A table that cannot be shown leaves its first block's text.
    """
    said = [(box, text.strip()) for box, text in blocks if text.strip()]
    owner = [next((k for k, (area, _) in enumerate(tables) if overlaps(box, area)), None) for box, _ in said]
    first = {k: at for at, k in reversed(list(enumerate(owner)))}
    parts = [text if k is None else tables[k][1] or text for at, (k, (_, text)) in enumerate(zip(owner, said)) if k is None or first[k] == at]
    parts += [shown for k, (_, shown) in enumerate(tables) if k not in first and shown]
    return "\n\n".join(parts).strip()


def first_overlap(blocks: DataFrame, tables: DataFrame, *, page: str = "page", block: str = "block", table: str = "table_idx", cells: int = 4) -> DataFrame:
    """Each block with the first table (by ``table``) of its page whose box it overlaps, else null.

    Boxes are dealt to the cells of a grid that they touch, and meet within cells of a page only. Cells are half as
    wide and high as the page's tables are on average, but a page of n tables has at most ``cells`` times the root of n
    columns and rows of them. Of the tables in a cell those are left out whose share of the cell an earlier table of it covers: whatever
    overlaps them there overlaps the earlier one too. So a cell keeps few tables however many touch it, and rows grow with the boxes, not their pairs.
    """
    width, height = (F.greatest(F.col(f"{b}") - F.col(f"{a}"), F.lit(0.0)) for a, b in (("x0", "x1"), ("y0", "y1")))
    root = F.lit(cells) * F.ceil(F.sqrt(F.count("*")))
    step = lambda mean, low, high: F.greatest(mean / 2, (F.max(high) - F.min(low)) / root, F.lit(1e-9))
    grid = tables.groupBy(page).agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"), F.max("x1").alias("_u"), F.max("y1").alias("_v"), step(F.avg(width), "x0", "x1").alias("_w"), step(F.avg(height), "y0", "y1").alias("_h"))

    def dealt(df: DataFrame) -> DataFrame:
        # what lies outside all tables of the page has no cell
        placed = df.join(grid, page)
        at = lambda c, low, high, size: F.floor((F.least(F.greatest(F.col(c).cast("double"), F.col(low)), F.col(high)) - F.col(low)) / F.col(size))
        spans = {"i": ("x0", "x1", "_x", "_u", "_w"), "j": ("y0", "y1", "_y", "_v", "_h")}
        known = placed.withColumns({f"_{k}{n}": at(c, low, high, size) for k, (a, z, low, high, size) in spans.items() for n, c in ((0, a), (1, z))})
        known = known.where(F.col("_i1") >= F.col("_i0")).where(F.col("_j1") >= F.col("_j0"))
        return known.withColumn("_i", F.explode(F.sequence("_i0", "_i1"))).withColumn("_j", F.explode(F.sequence("_j0", "_j1")))

    box = lambda side: [F.col(f"{side}.{c}") for c in ("x0", "y0", "x1", "y1")]
    b = dealt(blocks).select(page, block, "_i", "_j", "x0", "y0", "x1", "y1").alias("b")
    t = _uncovered(dealt(tables), page, table).select(page, table, "_i", "_j", "x0", "y0", "x1", "y1").alias("t")
    same = [F.col(f"b.{c}") == F.col(f"t.{c}") for c in (page, "_i", "_j")]
    met = b.join(t, [*same, overlaps(box("b"), box("t"))]).select(F.col(f"b.{page}").alias(page), F.col(f"b.{block}").alias(block), F.col(f"t.{table}").alias(table))
    alone = blocks.select(page, block, F.lit(None).cast(tables.schema[table].dataType).alias(table))
    return met.unionByName(alone).groupBy(page, block).agg(F.min(table).alias(table))


def _uncovered(dealt: DataFrame, page: str, table: str) -> DataFrame:
    """Of the tables in each cell those that no earlier one covers there.

    A table reaches beyond a side of the cell if it has a cell beyond it, or ends where the page's tables end. One
    that reaches beyond three sides covers all that lies inward of its fourth.
    """
    earlier = Window.partitionBy(page, "_i", "_j").orderBy(table).rowsBetween(Window.unboundedPreceding, -1)
    beyond = {
        "x0": (F.col("_i0") < F.col("_i")) | (F.col("x0") <= F.col("_x")), "x1": (F.col("_i1") > F.col("_i")) | (F.col("x1") >= F.col("_u")),
        "y0": (F.col("_j0") < F.col("_j")) | (F.col("y0") <= F.col("_y")), "y1": (F.col("_j1") > F.col("_j")) | (F.col("y1") >= F.col("_v")),
    }
    covered = F.lit(False)
    for side in beyond:
        low, others = side.endswith("0"), [c for s, c in beyond.items() if s != side]
        reach = F.when(others[0] & others[1] & others[2], F.when(beyond[side], F.lit(float("-inf" if low else "inf"))).otherwise(F.col(side).cast("double")))
        best, own = (F.min if low else F.max)(reach).over(earlier), F.col(side).cast("double")
        covered = covered | F.coalesce(best <= own if low else best >= own, F.lit(False))
    return dealt.withColumn("_covered", covered).where("NOT _covered")


def emitted_tables(matched: DataFrame, *, page: str = "page", block: str = "block", table: str = "table_idx") -> DataFrame:
    """Each matched table once, at its first block."""
    return matched.where(F.col(table).isNotNull()).groupBy(page, table).agg(F.min(block).alias(block))


def unmatched_tables(tables: DataFrame, matched: DataFrame, *, page: str = "page", table: str = "table_idx") -> DataFrame:
    """Tables that no block took; they follow at the end of their page."""
    return tables.join(matched.where(F.col(table).isNotNull()).select(page, table).distinct(), [page, table], "left_anti")
