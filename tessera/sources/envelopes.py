"""Search and detail replies of XML and JSON services as rows, by tables of field names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.blanks import strip


def _text(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit("")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for each row: a parse that an expression names for each of its fields would be made again for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _listed(tag: str, fields: dict[str, str]) -> str:
    """The type of the elements `tag` below a root, for `from_xml`."""
    schema = ", ".join(f"`{e}`: string" for e in dict.fromkeys(fields.values()))
    return f"`{tag}` array<struct<{schema}>>"


def _items(found: Column, fields: dict[str, str]) -> Column:
    return F.transform(F.filter(F.coalesce(found, F.array()), lambda x: x.isNotNull()), lambda x: F.struct(*[_text(x[e]).alias(n) for n, e in fields.items()]))


def _total(found: Column) -> Column:
    return F.coalesce(F.try_to_number(found, F.lit("999999999")).cast("int"), F.lit(0))


def xml_items(payload: Column, tag: str, fields: dict[str, str]) -> Column:
    """array<struct> of the elements `tag` below the root: the fields (name to element) as stripped strings, missing ones empty.

    A payload that isn't XML, is null or has no such element gives an empty array. One element and many are alike.
    """
    return _items(F.from_xml(payload, _listed(tag, fields), {"mode": "PERMISSIVE"})[tag], fields)


def xml_total(payload: Column, tag: str = "totalCnt") -> Column:
    return _total(F.from_xml(payload, f"`{tag}` string")[tag])


def xml_page(payload: Column, tag: str, fields: dict[str, str], total: str = "totalCnt") -> Column:
    """struct(total, items): `xml_total` and `xml_items` of one parse."""
    parsed = F.from_xml(payload, f"`{total}` string, {_listed(tag, fields)}", {"mode": "PERMISSIVE"})
    return once(parsed, lambda p: F.struct(_total(p[total]).alias("total"), _items(p[tag], fields).alias("items")))


def xml_detail(payload: Column, fields: dict[str, str], refused: str | None = "Law") -> Column:
    """struct of the root's own elements; null where the root's tag, if one is given, says that there is no such document, or nothing parses."""
    schema = ", ".join(f"`{e}` string" for e in dict.fromkeys(fields.values()))
    found = F.from_xml(payload, schema)
    if refused is not None:
        found = F.when(~F.coalesce(payload, F.lit("")).rlike(rf"^\s*(<\?[^>]*\?>\s*)?<{refused}[\s>/]"), found)
    return once(found, lambda parsed: F.when(parsed.isNotNull(), F.struct(*[_text(parsed[e]).alias(n) for n, e in fields.items()])))


def json_items(payload: Column, path: list[str], item: str) -> Column:
    """array of structs (schema: item) at the path; a single object there counts as an array of one, anything else as none."""
    found = F.get_json_object(payload, "$." + ".".join(path))
    many = F.from_json(found, f"array<{item}>")
    one = F.from_json(found, item)
    empty = F.array().cast(f"array<{item}>")
    return F.when(found.startswith("["), F.coalesce(many, empty)).when(found.startswith("{"), F.array(one)).otherwise(empty)


def variant_items(parsed: Column, path: list[str] | tuple[str, ...], item: str) -> Column:
    """`json_items` of a payload that `try_parse_json` has parsed already: one parse serves every path and shape asked of it."""
    at = "$" + "".join(f".{p}" for p in path)
    kind = F.schema_of_variant(F.try_variant_get(parsed, at, "variant"))
    many, one = F.try_variant_get(parsed, at, f"array<{item}>"), F.try_variant_get(parsed, at, item)
    empty = F.array().cast(f"array<{item}>")
    return F.when(kind.startswith("ARRAY"), F.coalesce(many, empty)).when(kind.startswith("OBJECT"), F.array(one)).otherwise(empty)


def law_metas(payload: Column, most: int = 10) -> Column:
    """array<struct<law_id,law_name,law_type,score,articles>> of data.results, the first `most`; missing strings are empty, a missing score is 0.

    A payload without that envelope, a flat one of earlier days or one that doesn't parse has none.
    """
    item = "struct<law_id:string,law_name:string,law_type:string,score:double,matched_articles:array<struct<label:string,snippet:string>>>"
    text = lambda c: F.coalesce(c, F.lit(""))
    found = F.slice(variant_items(F.try_parse_json(payload), ("data", "results"), item), 1, most)
    articles = lambda x: F.transform(F.coalesce(x["matched_articles"], F.array()), lambda a: F.struct(text(a["label"]).alias("label"), text(a["snippet"]).alias("snippet")))
    return F.transform(found, lambda x: F.struct(text(x["law_id"]).alias("law_id"), text(x["law_name"]).alias("law_name"), text(x["law_type"]).alias("law_type"), F.coalesce(x["score"].cast("int"), F.lit(0)).alias("score"), articles(x).alias("articles")))


@dataclass(frozen=True)
class Target:
    """Where a search service puts its items, and which of their fields tell what."""

    path: tuple[str, ...]
    number: str
    title: str
    subtitle: tuple[str, ...]
    date: str
    link: str


# Where each search service puts its items, and its fields.
TARGETS = {
    "law": Target(("LawSearch", "law"), "법령ID", "법령명한글", ("법령구분명", "소관부처명"), "시행일자", "법령상세링크"),
    "prec": Target(("PrecSearch", "prec"), "판례일련번호", "사건명", ("법원명", "사건번호"), "선고일자", "판례상세링크"),
    "expc": Target(("Expc", "expc"), "법령해석례일련번호", "안건명", ("회신기관명", "질의기관명"), "회신일자", "법령해석례상세링크"),
    "detc": Target(("DetcSearch", "detc"), "헌재결정례일련번호", "사건명", ("재판부", "사건번호"), "선고일자", "헌재결정례상세링크"),
    "decc": Target(("Decc", "decc"), "행정심판일련번호", "사건명", ("심판기관명", "사건번호"), "재결일자", "행정심판상세링크"),
    "admrul": Target(("AdmRulSearch", "admrul"), "행정규칙일련번호", "행정규칙명", ("행정규칙종류", "소관부처명"), "발령일자", "행정규칙상세링크"),
    "ordin": Target(("OrdinSearch", "law"), "자치법규일련번호", "자치법규명", ("지자체기관명", "자치법규분야명"), "공포일자", "자치법규상세링크"),
}
CATEGORIES = {0: "전체", 1: "정치·선거", 3: "언론·정신적자유", 4: "경제·재산권·조세", 5: "가족·노동·사회관계", 6: "절차적기본권·형사", 7: "헌법위원회·대법원헌법판례"}


def court_items(payload: Column, fields: tuple[str, ...] = ("seq", "nick", "title", "eventNo", "classNm", "adjudgeDt", "regDate")) -> Column:
    """array<struct> of body.items.item, one object or many, missing fields empty; a result code that isn't 0 or 00 is an error of the job."""
    code = F.get_json_object(payload, "$.header.resultCode")
    said = F.coalesce(F.get_json_object(payload, "$.header.resultMsg"), F.lit("unknown"))
    items = json_items(payload, ["body", "items", "item"], "struct<" + ",".join(f"{f}:string" for f in fields) + ">")
    good = F.transform(items, lambda x: F.struct(*[F.coalesce(x[f], F.lit("")).alias(f) for f in fields]))
    return F.when(code.isNull() | code.isin("0", "00"), good).otherwise(F.raise_error(F.concat(F.lit("the service answered with an error: "), said)))


def by_number(items: DataFrame, number: str, most: int = 5, column: str = "number", key: str = "id") -> DataFrame:
    """The first `most` items, by key, that have a key and the number in their own."""
    return items.where((F.coalesce(key, F.lit("")) != "") & F.col(column).contains(number)).orderBy(key).limit(most)


def search_results(replies: DataFrame, target: Target, site: str, payload: str = "payload") -> DataFrame:
    """Rows id, title, subtitle, date, url and raw for each item of each reply, by the target's table of fields.

    The subtitle joins the fields that aren't empty by a middle dot; a link that starts with / gets the site before it.
    """
    names = list(dict.fromkeys([target.number, target.title, *target.subtitle, target.date, target.link]))
    item = "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"
    rows = replies.select(F.explode(json_items(F.col(payload), list(target.path), item)).alias("x"))
    get = lambda n: F.coalesce(F.col("x")[n], F.lit(""))
    subtitle = F.concat_ws(" · ", F.filter(F.array(*[get(n) for n in target.subtitle]), lambda s: s != ""))
    link = get(target.link)
    return rows.select(get(target.number).alias("id"), get(target.title).alias("title"), subtitle.alias("subtitle"), get(target.date).alias("date"), F.when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(link).alias("url"), F.to_json("x").alias("raw"))


def search_mixed(replies: DataFrame, site: str, target: str = "target", payload: str = "payload") -> DataFrame:
    """(target, id, title, subtitle, date, url) of replies of all services in one table: each payload is parsed once, then read by its own service's fields.

    An item may be one object or many; replies of no known service, and payloads that don't parse, have no items.
    """
    parsed = replies.select(target, F.try_parse_json(payload).alias("v"))
    chosen = F.lit(None)
    for name, t in TARGETS.items():
        names = list(dict.fromkeys([t.number, t.title, *t.subtitle, t.date, t.link]))
        items = variant_items(F.col("v"), t.path, "struct<" + ",".join(f"`{n}`:string" for n in names) + ">")
        get = lambda x, n: F.coalesce(x[n], F.lit(""))
        own = F.transform(items, lambda x: F.struct(get(x, t.number).alias("id"), get(x, t.title).alias("title"), F.concat_ws(" · ", F.filter(F.array(*[get(x, s) for s in t.subtitle]), lambda s: s != "")).alias("subtitle"), get(x, t.date).alias("date"), get(x, t.link).alias("link")))  # noqa: B023
        chosen = F.when(F.col(target) == name, own).otherwise(chosen)
    link = F.col("link")
    return parsed.select(target, F.inline(chosen)).select(target, "id", "title", "subtitle", "date", F.when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(link).alias("url"))


def merged(detail: Column, item: Column) -> Column:
    """The detail's text, or the item's where that is empty or null, or nothing."""
    return F.coalesce(F.nullif(detail, F.lit("")), F.nullif(item, F.lit("")), F.lit(""))


def best_match(results: DataFrame, query: str, kind: str = "법률", name: str = "name", type_: str = "type") -> DataFrame:
    """The row with that name and kind, else of that kind with the query in its name, else the first; order: column `position`."""
    return results.orderBy(_priority(F.lit(query), kind, name, type_), "position").limit(1)


def _priority(query: Column, kind: str, name: str, type_: str) -> Column:
    return F.when((F.col(name) == query) & (F.col(type_) == kind), 0).when(F.col(name).contains(query) & (F.col(type_) == kind), 1).otherwise(2)


def best_matches(results: DataFrame, query: str = "query", query_id: str = "query_id", kind: str = "법률", name: str = "name", type_: str = "type") -> DataFrame:
    """`best_match` for many queries at once: results has query_id and query with each row."""
    order = Window.partitionBy(query_id).orderBy(_priority(F.col(query), kind, name, type_), "position")
    return results.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
