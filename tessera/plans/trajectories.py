"""Logs of model calls as event tables: totals, lineage, budgets, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import trees

SCHEMA = "trajectory_id string, event_id string, parent_event_id string, kind string, depth int, ts_ms double, payload string, tokens_in int, tokens_out int"
#: Caps of one trajectory (fixed values).
CAPS = {"tokens_in": 200_000, "tokens_out": 20_000, "call_out": 1024, "depth": 3, "sub_calls": 8}


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events from JSON lines of {trajectory_id, events: [...]}; missing token counts are 0, payloads stay JSON text."""
    event = "struct<event_id:string,parent_event_id:string,kind:string,depth:int,ts_ms:double,tokens_in:int,tokens_out:int>"
    rows = lines.select(F.from_json(value, f"trajectory_id string, events array<{event}>").alias("t"), F.from_json(value, "events array<struct<payload:string>>").alias("p"))
    each = rows.select("t.trajectory_id", F.posexplode(F.arrays_zip("t.events", F.col("p.events").alias("payloads"))).alias("position", "z"))
    return each.select("trajectory_id", "z.events.*", F.col("z.payloads.payload").alias("payload")).na.fill(0, ["tokens_in", "tokens_out"]).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def lines(events: DataFrame) -> DataFrame:
    """One JSON line for each trajectory, events in order of time; `parsed` reads it back."""
    fields = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    body = F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "event_id", F.struct(*fields).alias("e")))), lambda x: x["e"])
    return events.groupBy("trajectory_id").agg(body.alias("events")).select(F.to_json(F.struct("trajectory_id", "events")).alias("value"))


def lineage(events: DataFrame) -> DataFrame:
    """(root, node, depth): all events under each event without a parent."""
    links = events.where("parent_event_id is not null").select(F.col("parent_event_id").alias("parent"), F.col("event_id").alias("child"))
    return trees.descendants(links, events.where("parent_event_id is null").select(F.col("event_id").alias("root")))


def totals(events: DataFrame) -> DataFrame:
    """(trajectory_id, kind, n, tokens_in, tokens_out)."""
    return events.groupBy("trajectory_id", "kind").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def answer_totals(cycles: DataFrame, answer: str = "trajectory_id", tokens_in: str = "tokens_in", tokens_out: str = "tokens_out", cost: str = "usd") -> DataFrame:
    """(answer, cycles, tokens_in, tokens_out, usd): what each answer took over all its cycles; the cost to four places, halves to the even one."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return cycles.groupBy(answer).agg(F.count("*").alias("cycles"), total(tokens_in).alias("tokens_in"), total(tokens_out).alias("tokens_out"), F.bround(total(F.col(cost).cast("decimal(30,12)")), 4).cast("double").alias("usd"))


def over_budget(events: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """events in order with `exceeded`: the first cap that is crossed up to each event, or null. Use counts, then is judged."""
    so_far = Window.partitionBy("trajectory_id").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    used = lambda c: F.sum(F.greatest(F.lit(0), F.col(c))).over(so_far)
    calls = F.sum(F.when(F.col("kind") == "sub_llm_request", 1).otherwise(0)).over(so_far)
    crossed = F.when(F.max("depth").over(so_far) > caps["depth"], "depth").when(calls > caps["sub_calls"], "sub_calls").when(used("tokens_in") > caps["tokens_in"], "tokens_in").when(used("tokens_out") > caps["tokens_out"], "tokens_out")
    return events.withColumn("exceeded", crossed)


def answer(final: Column, error: Column) -> Column:
    """struct<verdict,confidence,citations> of a final answer in JSON: an array's objects are citations, ten at most, excerpts of 300 characters.

    An error leaves no verdict; citations apply at 0.7; another answer does not apply at 0.3; none is ambiguous at 0.5.
    """
    item = "struct<law_id:string,law_name:string,article:string,version:string,excerpt:string>"
    items = F.when(final.startswith("["), F.from_json(final, f"array<{item}>"))
    known = F.filter(F.slice(F.coalesce(items, F.array().cast(f"array<{item}>")), 1, 10), lambda x: x.isNotNull())
    none = lambda c: F.coalesce(c, F.lit(""))
    cited = F.transform(known, lambda x: F.struct(F.coalesce(x["law_id"], F.lit("unknown")).alias("law_id"), none(x["law_name"]).alias("law_name"), none(x["article"]).alias("article"), none(x["version"]).alias("version"), F.substring(none(x["excerpt"]), 1, 300).alias("excerpt")))
    failed, any_ = error.isNotNull(), F.size(cited) > 0
    return F.struct(
        F.when(failed, F.lit(None).cast("string")).when(any_, "applies").when(final.isNotNull(), "does_not_apply").otherwise("ambiguous").alias("verdict"),
        F.when(failed, 0.0).when(any_, 0.7).when(final.isNotNull(), 0.3).otherwise(0.5).alias("confidence"),
        F.when(failed, F.array().cast(f"array<{item}>")).otherwise(cited).alias("citations"),
    )
