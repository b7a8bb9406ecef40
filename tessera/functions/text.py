"""Scalar text functions as columns: tokens, keywords, markup, citations, scores of answers. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.blanks import SPACE, lines, strip

# Patterns and word lists that results depend on.
TOKEN = r"[가-힣]+|[a-zA-Z0-9]{2,}"
HANGUL_TOKEN = r"[가-힣]{2,}"
NAME_SUFFIX = r"(법률|시행령|시행규칙|법|규정|규칙)$"
STRUCTURAL = ["시행령", "시행규칙", "규정", "규칙", "법률", "요건", "시효", "효력", "책임", "보관기간", "보존기간", "처벌규정"]
ARTICLE_NUMBER = r"제\d+조(의\d+)?"
EMPTY_TOKEN = "_empty_"


def words(text: Column) -> Column:
    """The lower-case words of a text; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-case words and, after them, the two-character shingles of each; `_empty_` where there is none.

    Null counts as empty. A word of two characters appears twice, once as a word and once as its only shingle.
    """
    # shingles are looked for ahead of every place of the words in a row: no word holds a blank, so none crosses two
    pairs = lambda own: F.regexp_extract_all(F.array_join(own, " "), F.lit("(?=([^ ]{2}))"), F.lit(1))
    all_ = lambda own: F.when(F.size(own) > 0, F.concat(own, pairs(own))).otherwise(F.array(F.lit(EMPTY_TOKEN)))
    # an array of one list of words: the lambda's variable stands for it, so the pattern is looked for once a row
    return F.transform(F.array(words(text)), all_)[0]


def longest(values: Column) -> Column:
    """The longest string of the array, the first of equals; null for an empty array."""
    return F.reduce(values, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def filter_keyword(query: Column, name: Column) -> Column:
    """One Hangul substring of the query for a content filter; null without any token.

    With a recognised name: the longest token that isn't the name, its beginning or longer than it, nor structural. Else, by
    length, the first token that keeps three characters without its suffix, so stripped; else the longest token.
    """
    tokens = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(HANGUL_TOKEN), F.lit(0))
    topical = F.filter(tokens, lambda t: ~(t.startswith(name) | name.startswith(t)) & ~t.isin(STRUCTURAL))
    stripped = F.filter(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), F.regexp_replace(t, NAME_SUFFIX, "").alias("s"))), lambda p: F.length(p["s"]) >= 3)
    first = F.reduce(stripped, F.lit(None).cast("struct<n:int,s:string>"), lambda best, p: F.when(best.isNull() | (p["n"] > best["n"]), p).otherwise(best))["s"]
    return F.coalesce(F.when(name.isNotNull(), longest(topical)), first, longest(tokens))


def strip_html(html: Column) -> Column:
    """Line breaks for br tags, all other tags gone, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(html, rf"(?i)<br{SPACE}*/?>", "\n"), "<[^>]+>", ""))


def normal_date(date: Column) -> Column:
    """YYYY-MM-DD for eight digits with or without dots and dashes; anything else stays as it is."""
    digits = F.regexp_replace(strip(date), "[.-]", "")
    return F.when(digits.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))).otherwise(date)


def shown_date(date: Column) -> Column:
    """YYYY.MM.DD for eight digits, dots not counted; seven characters are malformed and become empty; anything else stays."""
    bare = F.translate(date, ".", "")
    dotted = F.concat_ws(".", F.substring(bare, 1, 4), F.substring(bare, 5, 2), F.substring(bare, 7, 2))
    return F.when(F.length(bare) == 7, "").when(bare.rlike("^[0-9]{8}$"), dotted).otherwise(date)


def frontmatter(text: Column) -> Column:
    """map<string,string> of the lines `key: value` between a leading --- and the next line that starts with ---; empty without both."""
    inner = F.regexp_extract(text, r"(?s)^---(.*?)\n---", 1)
    held = F.filter(lines(inner), lambda x: x.contains(":"))
    entries = F.transform(held, lambda x: F.struct(strip(F.split(x, ":", 2)[0]).alias("k"), F.regexp_replace(strip(F.split(x, ":", 2)[1]), "^['\"]+|['\"]+$", "").alias("v")))
    last = F.filter(F.transform(entries, lambda e, i: F.when(F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]), F.lit(None)).otherwise(e)), lambda e: e.isNotNull())
    return F.map_from_entries(last)


def article_reference(article: Column) -> Column:
    """§ and the first digits of an article's number; without digits the text itself."""
    digits = F.regexp_extract(article, r"(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("§"), digits)).otherwise(F.coalesce(article, F.lit("")))


def excerpt(document: Column, size: int = 400) -> Column:
    return F.translate(F.substring(F.coalesce(document, F.lit("")), 1, size), "\n", " ")


def article_label(number: Column) -> Column:
    """`제N조` around the number, without white space and, if it is a whole one, leading zeros; null for nothing."""
    bare = F.nullif(strip(number), F.lit(""))
    whole = F.when(bare.rlike(r"^[+-]?\d+$"), F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\d)", "$1"))
    return F.concat(F.lit("제"), F.coalesce(whole, bare), F.lit("조"))


def token_estimate(text: Column) -> Column:
    """0 for nothing, else a quarter of the characters, 1 at least."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def fenced_code(text: Column) -> Column:
    """What stands in the first python fence, else in the first fence, else the whole text; without white space at the ends."""
    named, plain = rf"(?s)```python{SPACE}*\n(.*?)```", rf"(?s)```{SPACE}*\n(.*?)```"
    return F.when(text.rlike(named), strip(F.regexp_extract(text, named, 1))).when(text.rlike(plain), strip(F.regexp_extract(text, plain, 1))).otherwise(strip(text))


def rank_list(reply: Column) -> Column:
    """The first bracket of numbers as array<int>; null where none parses."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"\[[\d,\s]+\]", 0), F.lit("")), "array<int>")


def first_object(reply: Column, schema: str) -> Column:
    """The first {...} (up to the first closing brace) parsed by the schema; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*?\}", 0), F.lit("")), schema)


def passes(reply: Column) -> Column:
    """Whether PASS follows the last `VERDICT:`, in whatever case."""
    return F.coalesce(F.element_at(F.split(F.upper(reply), "VERDICT:"), -1).contains("PASS"), F.lit(False))


def is_fixed_point(one: Column, two: Column, least_length: float = 0.85, least_same: float = 0.8) -> Column:
    """Whether two texts say much the same, place by place: blanks and line ends don't count; short ones must be equal. Nothing is like nothing."""
    a, b = F.translate(F.coalesce(one, F.lit("")), " \n", ""), F.translate(F.coalesce(two, F.lit("")), " \n", "")
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.arrays_zip(F.split(F.substr(a, F.lit(1), low), "").alias("x"), F.split(F.substr(b, F.lit(1), low), "").alias("y")), lambda p: p["x"] == p["y"]))
    nothing = (F.coalesce(one, F.lit("")) == "") | (F.coalesce(two, F.lit("")) == "")
    return F.when(nothing, F.lit(False)).when((F.length(a) < 100) | (F.length(b) < 100), a == b).when(low / high < least_length, F.lit(False)).otherwise(same / high > least_same)


def hit_strings(text: Column, wanted: Column) -> Column:
    """Those of the wanted strings that the text holds; null text holds none."""
    return F.filter(wanted, lambda k: F.coalesce(text, F.lit("")).contains(k))


def hit_articles(text: Column, wanted: Column) -> Column:
    """Those of the wanted articles whose number the text holds; without a number, whose whole name it holds."""
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, ARTICLE_NUMBER, 0), F.lit("")), x)
    return F.filter(wanted, lambda k: F.coalesce(text, F.lit("")).contains(number(k)))


def hit_rate(hits: Column, wanted: Column) -> Column:
    """The share of hits, of one at least, to two places, halves to the even one."""
    return F.bround(F.size(hits) / F.greatest(F.lit(1), F.size(wanted)), 2)


def signed(value: Column) -> Column:
    return F.format_string("%+.2f", value)


def safe_identifier(text: Column) -> Column:
    """At most 40 characters, `_` for all but ASCII letters, digits and `_`; different texts may come to the same."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"), 1, 40)


def strip_line_number(line: Column) -> Column:
    """A search hit's line without `path:12:` or `path-12-` before it."""
    return F.regexp_replace(line, r"(?s)^[^:]+[-:](\d+)[-:](.*)$", "$2")


def joined_excerpt(lines: Column, size: int = 400) -> Column:
    """The lines (one string) without what a search put before them, stripped, with a middle dot between those that aren't empty."""
    bare = F.transform(F.split(F.coalesce(lines, F.lit("")), "\n"), lambda x: strip(strip_line_number(x)))
    return F.substring(F.concat_ws(" · ", F.filter(bare, lambda x: x != "")), 1, size)


def mock_reply(messages: Column) -> Column:
    """A reply that depends on nothing but the messages (array<struct<role,content>>): twelve digits of the checksum of their JSON, keys in order."""
    escaped = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    shown = F.transform(messages, lambda m: F.concat(F.lit('{"content": '), escaped(m["content"]), F.lit(', "role": '), escaped(m["role"]), F.lit("}")))
    return F.concat(F.lit("[dry_run] deterministic mock response hash="), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", shown), F.lit("]")), 256), 1, 12))
