"""What each filter of a chain removes under every order of the chain, from one count of documents by the filters that they fail.

Documents are counted once in cells: a part of the corpus, and a mask of the filters failed. Orders are visited by swaps of two
neighbours (plain changes), each of which changes two steps; only those are summed again from the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import materialize

#: What stands between words (fixed values).
BLANK = " \t\n\v\f\r"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def standard(text: Column) -> dict[str, Column]:
    """The conditions A to D under which a text fails: few words, few different words, many capitals, markup. E needs the table."""
    bare = F.btrim(text, F.lit(BLANK))
    words, none = F.split(bare, f"[{BLANK}]+"), (bare == "").cast("int")
    count, different = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": count < 50, "B": 100 * different < 65 * count, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def plain_changes(count: int) -> Iterator[int]:
    """Where the next two neighbours are swapped, until all orders of `count` things were visited once (Steinhaus, Johnson, Trotter)."""
    order, way = list(range(count)), [-1] * count
    while True:
        free = [x for x in order if 0 <= order.index(x) + way[x] < count and order[order.index(x) + way[x]] < x]
        if not free:
            return
        x = max(free)
        at = order.index(x)
        to = at + way[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, count):
            way[y] = -way[y]
        yield min(at, to)


def walk(cells: np.ndarray, filters: int) -> tuple[list[list[int]], np.ndarray]:
    """All orders of the filters, and [order, step, count, part] for cells [3, mask, part] of documents, good and toxic ones.

    Counts are those of COUNTS; the last is the filter's removals summed over all orders, as they were met on the walk.
    """
    masks = np.arange(1 << filters)

    def step(order: list[int], place: int) -> np.ndarray:
        """kept, removed, redundant, good and toxic removed at one step."""
        own, before = masks >> order[place] & 1 == 1, sum(1 << f for f in order[:place])
        gone, out, over = own & (masks & before == 0), masks & (before | 1 << order[place]) == 0, own & (masks & before != 0)
        return np.stack([cells[0, out].sum(axis=0), cells[0, gone].sum(axis=0), cells[0, over].sum(axis=0), cells[1, gone].sum(axis=0), cells[2, gone].sum(axis=0)])

    order = list(range(filters))
    now = [step(order, place) for place in range(filters)]
    orders, rows, shapley = [], [], np.zeros((filters, cells.shape[2]), np.int64)
    swaps = plain_changes(filters)
    while True:
        orders.append(list(order))
        rows.append(np.stack(now))
        for place, f in enumerate(order):
            shapley[f] += now[place][1]
        at = next(swaps, None)
        if at is None:
            break
        order[at], order[at + 1] = order[at + 1], order[at]
        now[at], now[at + 1] = step(order, at), step(order, at + 1)
    found = np.stack(rows)
    at = np.array(orders)
    alone = cells[0][1 << at]  # [order, step, part]
    out = np.stack([found[:, :, 0], found[:, :, 1], found[:, :, 2], alone, found[:, :, 3], found[:, :, 4], shapley[at]], axis=2)
    return orders, out


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, A the lowest bit of the mask.

    E is told by a SHA-256 of the text. Rows are counted by text, key and mask first; so copies and repeated rows are few rows
    before any of them meet, and the least key of a text is found by sums, not by gathering its copies.
    """
    body, name, kind = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{key}`"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    rows = docs.select(body.alias("body"), name.alias("id"), kind.alias("part"))
    fails = standard(F.col("body"))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << bit) for bit, c in enumerate(fails.values())), F.lit(0))
    rows = rows.select(F.unhex(F.sha2("body", 256)).alias("same"), "id", "part", mask.alias("mask")).groupBy("same", "id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(f"`{key}`").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "id", "left").select("same", "id", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # a row for each text and cell: all its documents, those without a key, the least key and how many have it
    groups = rows.groupBy("same", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("bare"), F.min("id").alias("least"), F.min_by("n", "id").alias("held"))
    groups = materialize(groups, "audit")
    first = groups.groupBy("same").agg(F.min("least").alias("first"))
    groups = groups.join(first, "same").withColumn("own", F.col("bare") + F.when(F.col("least") == F.col("first"), F.col("held")).otherwise(0))
    copies = F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n"))
    each = groups.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("own").alias("n")), copies)))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order and step.

    counted: (part, mask, n, good, toxic) as `cells` gives them; a part has 2**len(filters) rows at most, which meet in one row.
    Parts are worked on in batches. An empty table gives no rows.
    """
    size = len(filters)
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                held = rows.column("cells")
                at = np.repeat(np.arange(rows.num_rows), np.asarray(held.value_lengths()))
                flat = held.flatten()
                table = np.zeros((3, 1 << size, rows.num_rows), np.int64)
                for k, c in enumerate(("n", "good", "toxic")):
                    np.add.at(table[k], (np.asarray(flat.field("mask")), at), np.asarray(flat.field(c)))
                names, counts = walk(table, size)
                labels = pa.array(["".join(filters[f] for f in o) for o in names]).take(pa.array(np.repeat(np.arange(len(names)), size)))
                each = len(names) * size
                columns = [rows.column("part").take(pa.array(np.tile(np.arange(rows.num_rows), each))), labels.take(pa.array(np.repeat(np.arange(each), rows.num_rows))), pa.array(np.repeat(np.tile(np.arange(1, size + 1), len(names)), rows.num_rows), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[:, :, k].reshape(-1)) for k in range(len(COUNTS))]], ["part", "filter_order", "step", *COUNTS])

    return packed.mapInArrow(orders, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def interactions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """`audit` over `cells`: what A, few words; B, few different words; C, capitals; D, markup; E, an earlier copy remove in each order.

    A null text is the empty one, a null part the empty string. A null key is earlier or later than none, so E spares its row; rows
    that repeat a key and text are no copies of each other. A document is good or toxic where any label row says 1. Texts of any
    length are whole. Other columns don't matter, whatever their names. An empty table gives no rows.
    """
    return audit(cells(docs, labels, key, text, part))
