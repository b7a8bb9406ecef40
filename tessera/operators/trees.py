"""Heading trees as tables: parsing, subtrees, outlines, budgets and renderings."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import safe_identifier
from tessera.sources.tables import written

#: A heading, and names of heading depths (fixed values); deeper ones are h6 and so on.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
LEVELS = {1: "law", 2: "chapter", 3: "section", 4: "subsection", 5: "article"}


#: Spark's setting for the most rows of a recursion.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def level_name(level: Column) -> Column:
    names = F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, level), F.concat(F.lit("h"), level.cast("string")))


def _sections(text: str) -> tuple[list[tuple[int, int, str]], list[str]]:
    """(line, level, title) of each heading of a text without its front matter, and the text up to the next one."""
    if text.startswith("---") and (end := text.find("\n---", 3)) >= 0:
        text = text[end + 4 :]
    lines = text.splitlines()
    marks = [(k, m) for k, line in enumerate(lines) if line[:1] == "#" and (m := HEADING.match(line))]
    ends = [k for k, _ in marks[1:]] + [len(lines)]
    return [(k, len(m[1]), m[2].strip()) for k, m in marks], ["\n".join(lines[k + 1 : end]).strip() for (k, _), end in zip(marks, ends)]


def _placed(name: str, levels: list[int]) -> tuple[list[str], list[str], list[list[str]]]:
    """Identifiers of a document's headings, of their parents, and the ancestors' identifiers with the own one.

    A heading is numbered among those of its depth since the last shallower one; deeper numbers begin anew with it.
    """
    counts, open_ = np.zeros(8, np.int64), {0: (name, [])}
    names, parents, paths = [], [], []
    for level in levels:
        counts[level] += 1
        counts[level + 1 :] = 0
        open_ = {d: v for d, v in open_.items() if d < level}
        parent, path = open_[max(open_)]
        own = f"{parent}.{LEVELS.get(level, f'h{level}')}{counts[level]}"
        open_[level] = (own, [*path, own])
        names.append(own)
        parents.append(parent)
        paths.append(open_[level][1])
    return names, parents, paths


def _parsed(docs: DataFrame, key: str, text: str, placed: bool) -> DataFrame:
    """Headings of each document, with their places in the tree or without: a document is read in one go, and none moves."""
    own = docs.schema[key]
    kind = T.StructType([T.StructField(key, own.dataType), *T.StructType.fromDDL("line int, level int, title string, body string").fields])
    if placed:
        kind = T.StructType([*kind.fields, *T.StructType.fromDDL("node_id string, parent_id string, level_name string, preorder int, path array<string>").fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pc.cast(batch.column(2), pa.string())
            rows, at, size = {f.name: [] for f in kind.fields[1:]}, [], 0
            for k in range(batch.num_rows):
                marks, bodies = _sections(batch.column(1)[k].as_py() or "")
                line, level, title = zip(*marks) if marks else ((), (), ())
                values = [line, level, title, bodies]
                if placed:
                    own, parents, paths = _placed(names[k].as_py() or "", list(level))
                    values += [own, parents, [LEVELS.get(x, f"h{x}") for x in level], range(1, len(level) + 1), paths]
                for c, v in zip(rows, values):
                    rows[c].extend(v)
                at += [k] * len(marks)
                size += sum(map(len, bodies))
                if size > 4 << 20 or k == batch.num_rows - 1:  # rows of a few MB leave at once
                    arrow = to_arrow_schema(kind)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, arrow.field(c).type) for c, v in rows.items()]], [key, *rows])
                    rows, at, size = {c: [] for c in rows}, [], 0

    return docs.select(key, F.col(text).alias("text"), F.col(key).cast("string").alias("name")).mapInArrow(parse, kind)


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, level, title, body): the headings of each document with the text up to the next one.

    Lines end as `functions.blanks` says. Front matter and what stands before the first heading go. Null and heading-free texts have
    no rows. Repeated keys are documents of their own.
    """
    return _parsed(docs, key, text, placed=False)


def tree(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, node_id, parent_id, level, level_name, title, body, preorder, path): a row for each heading.

    A heading's parent is the nearest earlier one of a smaller depth, the document else. Identifiers count headings of one depth
    since the last shallower heading, whatever their parents: parent.level+number. path holds the ancestors' identifiers and its own.
    A document is parsed where it is read: nothing is shuffled.
    """
    return _parsed(docs, key, text, placed=True).select(key, "node_id", "parent_id", "level", "level_name", "title", "body", "preorder", "path")


def subtree(nodes: DataFrame, node_id: str | Column, levels: list[str] | None = None) -> DataFrame:
    """The node and all below it in preorder columns; only those of the named levels if given."""
    inside = nodes.where(F.array_contains("path", node_id))
    return inside.where(F.col("level_name").isin(levels)) if levels else inside


def descendants(links: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """(root, node, depth) over a table of links (parent, child): every node that a root leads to, itself at depth 0.

    A recursion in the plan itself: one query, in which Spark joins the last level's nodes with the links until there are none. A
    node that is reached over two ways stands there twice. More than `most` levels are an error, so a circle ends; there is no limit
    of rows. The links are written once, for each level reads them, and so is the result, so that the error comes here.
    """
    held = f"links_{uuid.uuid4().hex}"
    written(links.select("parent", "child"), "links").createOrReplaceTempView(held)
    start = f"roots_{uuid.uuid4().hex}"
    roots.select("root").createOrReplaceTempView(start)
    spark = links.sparkSession
    rows = spark.sql(f"""
        WITH RECURSIVE down(root, node, depth) MAX RECURSION LEVEL {most} AS (
            SELECT root, root, 0 FROM {start}
            UNION ALL
            SELECT root, child, depth + 1 FROM down JOIN {held} ON parent = node)
        SELECT root, node, depth FROM down""")
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")  # all of them
    try:
        return written(rows, "descendants")
    except (PySparkException, Py4JJavaError) as error:
        if "RECURSION_LEVEL_LIMIT_EXCEEDED" not in str(error):
            raise
        raise ValueError(f"links lead over more than {most} levels") from error
    finally:
        spark.conf.set(ROW_LIMIT, before)
        spark.catalog.dropTempView(held)
        spark.catalog.dropTempView(start)


def under_root(nodes: DataFrame, root: str, title: str, key: str = "doc_id") -> DataFrame:
    """One tree of all documents: each document becomes a node under the root, its headings stay below it, a level deeper.

    Columns are those of `tree`; key is the root everywhere. A document's preorder and titles follow its key's order.
    """
    named = F.concat_ws(".", F.lit(root), F.col(key).cast("string"))
    moved = lambda c: F.concat(F.lit(f"{root}."), c)
    place = lambda preorder: F.struct(F.col(key).cast("string").alias("document"), preorder.alias("preorder"))
    below = nodes.select(
        F.lit(root).alias("root"), moved(F.col("node_id")).alias("node_id"), moved(F.col("parent_id")).alias("parent_id"), (F.col("level") + 1).alias("level"), "level_name", "title", "body",
        place(F.col("preorder")).alias("preorder"), F.concat(F.array(F.lit(root), named), F.transform("path", moved)).alias("path"),
    )
    heads = nodes.select(key).distinct().select(
        F.lit(root).alias("root"), named.alias("node_id"), F.lit(root).alias("parent_id"), F.lit(1).alias("level"), F.lit("source").alias("level_name"), F.col(key).cast("string").alias("title"), F.lit("").alias("body"),
        place(F.lit(0)).alias("preorder"), F.array(F.lit(root), named).alias("path"),
    )
    top = nodes.sparkSession.createDataFrame([(root, root, None, 0, "root", title, "")], "root string, node_id string, parent_id string, level int, level_name string, title string, body string")
    top = top.withColumn("preorder", F.struct(F.lit("").alias("document"), F.lit(0).alias("preorder"))).withColumn("path", F.array("node_id"))
    return top.unionByName(heads).unionByName(below)


def _lines(nodes: DataFrame, key: str, first: Column, line: Column, deepest: int, depth: Column) -> DataFrame:
    """(key, text): a first line, then a line for each node of that depth or less, in preorder."""
    rows = nodes.where(depth <= deepest).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("preorder", line.alias("s")))).alias("ls"))
    return rows.select(key, F.concat_ws("\n", first, F.transform("ls", lambda x: x["s"])).alias("text"))


def outline(nodes: DataFrame, depth: int = 3, key: str = "doc_id", title: Column | None = None, characters: int | None = 18_000) -> DataFrame:
    """(key, outline): `[root] key :: title`, then a line for each heading down to depth below it, two blanks for each ancestor,
    `[level] identifier :: title`; all cut at so many characters. Depth counts ancestors, not the marks of a heading."""
    name = F.col(key).cast("string")
    line = F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("["), F.col("level_name"), F.lit("] "), F.col("node_id"), F.lit(" :: "), F.col("title"))
    first = F.concat(F.lit("[root] "), name, F.lit(" :: "), name if title is None else title)
    text = _lines(nodes, key, first, line, depth, F.size("path"))
    return text.select(key, (F.substring("text", 1, characters) if characters else F.col("text")).alias("outline"))


def text_tree(nodes: DataFrame, depth: int = 4, key: str = "doc_id", title: Column | None = None) -> DataFrame:
    """(key, tree): the title, then `[level] title` for each heading down to depth, two blanks for each ancestor."""
    line = F.concat(F.repeat(F.lit("  "), F.size("path")), F.lit("["), F.col("level_name"), F.lit("] "), F.col("title"))
    return _lines(nodes, key, F.col(key).cast("string") if title is None else title, line, depth, F.size("path")).withColumnRenamed("text", "tree")


def within_budget(rows: DataFrame, size: Column, budget: int, group: str, order: str) -> DataFrame:
    """The rows of each group, in order, before the first with which their sizes' sum exceeds the budget; later small ones don't slip in."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(size).over(upto)).withColumn("_over", F.max(F.when(F.col("_sum") > budget, 1).otherwise(0)).over(upto)).where("_over = 0").drop("_sum", "_over")


def statistics(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, nodes, articles, max_depth)."""
    return nodes.groupBy(key).agg(F.count("*").alias("nodes"), F.count_if(F.col("level_name") == "article").alias("articles"), F.max("level").alias("max_depth"))


def mermaid(nodes: DataFrame, depth: int = 3, key: str = "doc_id", title: Column | None = None, label: int | None = 60) -> DataFrame:
    """(key, chart): a top-down flow chart of the headings down to depth and their children.

    A node stands as `identifier["title"]` before its first edge, then `parent --> node`. Identifiers are made safe; of those that
    come to the same only the first node stands, as the chart knows them by name only. Quotes in titles become single ones.
    """
    shown = lambda c: F.concat(F.lit('["'), F.translate(c if label is None else F.substring(c, 1, label), '"', "'"), F.lit('"]'))
    name, own = F.col(key).cast("string"), safe_identifier(F.col("node_id"))
    rows = nodes.where(F.size("path") <= depth + 1).withColumn("own", own)
    fresh = (F.row_number().over(Window.partitionBy(key, "own").orderBy("preorder")) == 1) & (F.col("own") != safe_identifier(name))
    node = F.when(F.col("fresh"), F.concat(F.lit("    "), F.col("own"), shown(F.col("title"))))
    line = F.concat_ws("\n", node, F.concat(F.lit("    "), safe_identifier(F.col("parent_id")), F.lit(" --> "), F.col("own")))
    first = F.concat(F.lit("flowchart TD\n    "), safe_identifier(name), shown(name if title is None else title))
    return _lines(rows.withColumn("fresh", fresh), key, first, line, depth + 1, F.size("path")).withColumnRenamed("text", "chart")
