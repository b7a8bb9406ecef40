"""Documents from service replies: bodies, headers, labelled sections, articles near keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.blanks import strip

# Kinds of statutes by code, and heading patterns.
KINDS = {"A0002": "법률", "A0003": "시행령", "A0004": "시행규칙", "A0005": "고시"}
ARTICLE_HEADING = r"##### (제\d+조(?:의\d+)?)"


def _strip(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit("")))


def kind_of(code: Column, kinds: dict[str, str] = KINDS, default: str = "법률") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), code), F.lit(default))


def body(summary: Column, holding: Column, full: Column, limit: int = 2000) -> Column:
    """The summary; without one the holding with the beginning of the full text; without both the full text."""
    s, h, f = _strip(summary), _strip(holding), _strip(full)
    return F.when(s != "", s).when(h != "", F.concat(h, F.when(f != "", F.concat(F.lit("\n\n"), F.substring(f, 1, limit))).otherwise(""))).otherwise(f)


def _dotted(date: Column) -> Column:
    return F.concat_ws(".", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))


def _labelled(court: Column, number: Column, shown: Column, name: Column, sections: dict[str, Column], limit: int) -> Column:
    text = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("["), text(court), F.lit(" "), text(number), F.lit(" ("), shown, F.lit(")] "), text(name))
    parts = [F.when(text(c) != "", F.concat(F.lit(f"\n{label}:\n"), c)) for label, c in sections.items()]
    return F.substring(F.concat_ws("\n", head, *parts), 1, limit)


def decision(court: Column, number: Column, date: Column, name: Column, sections: dict[str, Column], limit: int = 8000) -> Column:
    """`[court number (date)] name` and, each after a blank line, the sections that aren't empty under their labels."""
    given = F.coalesce(date, F.lit(""))
    return _labelled(court, number, F.when(F.length(given) == 8, _dotted(given)).otherwise(given), name, sections, limit)


def article_body(paragraphs: Column, content: Column) -> Column:
    """An article of paragraphs (array<struct<text,items array<string>>>): a line each, items two blanks in; without paragraphs its content."""
    lines = F.flatten(F.transform(paragraphs, lambda p: F.concat(F.array(_strip(p["text"])), F.transform(F.filter(F.coalesce(p["items"], F.array().cast("array<string>")), lambda i: _strip(i) != ""), lambda i: F.concat(F.lit("  "), _strip(i))))))
    return F.when(F.size(F.coalesce(paragraphs, F.array().cast("array<struct<text:string,items:array<string>>>"))) > 0, F.concat_ws("\n", F.filter(lines, lambda x: x != ""))).otherwise(_strip(content))


def articles_near(text: Column, keywords: Column, window: int = 2500, most: int = 8, by_keyword: bool = False) -> Column:
    """The first `most` articles that hold a keyword within `window` characters of their heading, each once.

    by_keyword lists the first keyword's articles before the second's; otherwise they stand in the order of the text.
    """
    heads = F.regexp_extract_all(text, F.lit(ARTICLE_HEADING), F.lit(1))
    parts = F.split(text, ARTICLE_HEADING)
    # each heading's window begins at the heading: what follows it, with the headings in between put back
    rest = lambda i: F.concat(F.lit("##### "), heads[i], F.array_join(F.flatten(F.transform(F.sequence(i + 1, F.size(heads)), lambda j: F.array(parts[j], F.when(j < F.size(heads), F.concat(F.lit("##### "), F.get(heads, j))).otherwise("")))), ""))
    entries = F.transform(heads, lambda h, i: F.struct(h.alias("a"), F.substring(rest(i), 1, window).alias("w")))
    none = F.array().cast("array<string>")
    holds = lambda k: F.transform(F.filter(entries, lambda e: e["w"].contains(k)), lambda e: e["a"])
    if by_keyword:
        found = F.flatten(F.transform(keywords, holds))
    else:
        found = F.transform(F.filter(entries, lambda e: F.exists(keywords, lambda k: e["w"].contains(k))), lambda e: e["a"])
    return F.when(F.size(heads) > 0, F.slice(F.array_distinct(found), 1, most)).otherwise(none)


def found_body(text: Column, article: Column) -> Column:
    """The text from the first fifth-level heading of the article up to the next one, a section or a law, stripped; null where there is none.

    `제1조` doesn't find `제1조의2`: a word must end after it.
    """
    pattern = F.concat(F.lit(r"(?sU)##### \Q"), F.replace(article, F.lit("\\E"), F.lit("")), F.lit(r"\E\b.*?(?=\n##### |\n## |\n# |\z)"))
    found = F.regexp_substr(text, pattern)
    return F.when(found.isNotNull(), _strip(found))


def article_bodies(hits: Column, sources: Column) -> Column:
    """`[label article]` and the body of each of hits (array<struct<label,article>>), in order, with a rule between; empty for none.

    sources: map of label to the whole text. Labels without a text and articles that a text lacks are left out.
    """
    bodies = F.transform(hits, lambda h: F.concat(F.lit("["), h["label"], F.lit(" "), h["article"], F.lit("]\n"), found_body(F.try_element_at(sources, h["label"]), h["article"])))
    return F.concat_ws("\n\n---\n\n", F.filter(bodies, lambda b: b.isNotNull()))


def joined_bodies(bodies: Column) -> Column:
    """Bodies with a rule between them; `(no article matched)` for none."""
    return F.when(F.size(bodies) > 0, F.concat_ws("\n\n---\n\n", bodies)).otherwise("(no article matched)")


def split_pair(spec: Column) -> Column:
    """struct<left,right> around the first colon, stripped; null where a side is missing or blank."""
    left, right = _strip(F.get(F.split(spec, ":", 2), F.lit(0))), _strip(F.get(F.split(spec, ":", 2), F.lit(1)))
    return F.when((left != "") & (right != ""), F.struct(left.alias("left"), right.alias("right")))


def with_suffix(messages: Column, suffix: str) -> Column:
    """array<struct<role,content>> whose last user message ends with the suffix; where it does already, or none is there, unchanged."""
    last = F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "user", i)), lambda i: i.isNotNull()))
    add = lambda m, i: (i == last) & ~F.endswith(m["content"], F.lit(suffix))
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(F.coalesce(add(m, i), F.lit(False)), F.concat(m["content"], F.lit(" " + suffix))).otherwise(m["content"]).alias("content")))


def interpretation(issuer: Column, number: Column, date: Column, listed: Column, title: Column, sections: dict[str, Column], reason: Column, limit: int = 8000, reason_limit: int = 3000) -> Column:
    """Like a decision, with the reason, cut, as the last section. A date that isn't eight characters long gives way to the listed one."""
    shown = F.when(F.length(date) == 8, _dotted(date)).otherwise(F.coalesce(listed, F.lit("")))
    return _labelled(issuer, number, shown, title, {**sections, "이유": F.substring(F.coalesce(reason, F.lit("")), 1, reason_limit)}, limit)


def constitutional(number: Column, name: Column, text: Column, limit: int = 8000) -> Column:
    """A head with the case's number and name, then the body; null without a body or a number."""
    good = (F.coalesce(number, F.lit("")) != "") & (_strip(text) != "")
    return F.when(good, F.substring(F.concat(F.lit("[헌법재판소 "), number, F.lit("] "), F.coalesce(name, F.lit("")), F.lit("\n"), text), 1, limit))
