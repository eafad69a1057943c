"""Row classifiers as native column expressions; the first matching rule wins."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, urls


def _first(cases: list[tuple[Column, str]], default: str) -> Column:
    expr = F.when(cases[0][0], F.lit(cases[0][1]))
    for cond, label in cases[1:]:
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so an expression that uses it many times stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(words: Sequence[str]) -> str:
    """One alternation that matches any word literally."""
    return "|".join(re.escape(w).replace(r"\-", "-").replace("/", "/") for w in words)


def ua_class(ua: Column, patterns: Sequence[str] = rules.BOT_UA_SUBSTRINGS) -> Column:
    text = F.coalesce(ua, F.lit(""))
    return _first(
        [(F.trim(text) == "", "empty"), (F.lower(text).rlike(any_of(patterns)), "bot")], "browser"
    )


def verdict(
    ua: Column,
    has_visitor_cookie: Column,
    request_origin: Column,
    is_authenticated: Column,
    patterns: Sequence[str] = rules.BOT_UA_SUBSTRINGS,
) -> Column:
    """Struct of the human/bot decision and the evidence it rests on."""
    family = ua_class(ua, patterns)
    human = F.coalesce(is_authenticated, F.lit(False)) | F.coalesce(
        (request_origin == "web") & (family == "browser") & has_visitor_cookie, F.lit(False)
    )
    return F.struct(
        human.alias("is_human"),
        (~human).alias("is_bot"),
        has_visitor_cookie.alias("has_visitor_cookie"),
        family.alias("ua_class"),
        request_origin.alias("request_origin"),
        is_authenticated.alias("is_authenticated"),
    )


def percent_decode(text: Column) -> Column:
    """One decode pass that leaves '+' alone; text with a broken sequence stays raw."""
    return let(text, lambda t: F.coalesce(F.try_url_decode(F.regexp_replace(t, r"\+", "%2B")), t))


def not_found_category(
    url: Column, catalogue: Sequence[tuple] = rules.NOT_FOUND_RULES, default: str = rules.NOT_FOUND_DEFAULT
) -> Column:
    lowered = F.lower(url)
    bare = F.regexp_replace(lowered, r"/+$", "")
    decoded = percent_decode(url)
    tests = {
        "re": lambda p: url.rlike(p),
        "re_decoded": lambda p: url.rlike(p) | decoded.rlike(p),
        "path_lower": lambda p: bare.isin(list(p)),
        "equals_lower": lambda p: lowered.isin(list(p)),
        "prefix": lambda p: url.rlike("^(?:" + any_of(p) + ")"),
        "prefix_lower": lambda p: lowered.rlike("^(?:" + any_of(p) + ")"),
    }
    return _first([(tests[kind](pattern), label) for label, kind, pattern in catalogue], default)


def is_actionable(category: Column, categories: Sequence[str] = rules.ACTIONABLE_404) -> Column:
    return category.isin(list(categories))


def is_scanner(category: Column, categories: Sequence[str] = rules.SCANNER_404) -> Column:
    return category.isin(list(categories))


def decoded_term(term: Column) -> Column:
    """Search text after dropping backslash escapes, entities and three URL decodes."""
    text = unslash(term)
    for entity, char in rules.HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    for _ in range(3):
        text = percent_decode(text)
    return text


def unslash(term: Column) -> Column:
    return F.regexp_replace(term, r"(?s)\\(.)", "$1")


def search_payload(term: Column, catalogue: Sequence[tuple] = rules.SEARCH_PAYLOAD_RULES) -> Column:
    """Struct of pattern, family and matched token; NULL for harmless text."""

    def verdict_of(view: Column) -> Column:
        cases = []
        for name, family, regex, on_raw in catalogue:
            text = view["raw"] if on_raw else view["clean"]
            cases.append(
                F.when(
                    text.rlike(regex),
                    F.struct(
                        F.lit(name).alias("pattern_name"),
                        F.lit(family).alias("pattern_family"),
                        F.substring(F.regexp_extract(text, regex, 0), 1, 120).alias("matched_token"),
                    ),
                )
            )
        return F.coalesce(*cases)

    views = F.struct(unslash(term).alias("raw"), decoded_term(term).alias("clean"))
    return F.when(term != "", let(views, verdict_of))


def search_source(source_url: Column, request_uri: Column | None = None) -> Column:
    url = F.lower(F.coalesce(source_url, F.lit("")))
    cases = []
    if request_uri is not None:
        cases.append(
            (F.lower(F.coalesce(request_uri, F.lit(""))).contains(rules.FORUM_SEARCH_MARKER), "bbpress_forum")
        )
    cases += [
        (F.trim(url) == "", "unknown"),
        (url.rlike(any_of(rules.SEARCH_SURFACE_MARKERS)), "archive"),
    ]
    return _first(cases, "nav")


def outbound_category(
    dest_host: Column, catalogue: Sequence[tuple] = rules.OUTBOUND_RULES, default: str = rules.OUTBOUND_DEFAULT
) -> Column:
    """Category by ordered host substrings, so a longer host can match a short needle."""
    name = F.lower(F.trim(F.coalesce(dest_host, F.lit(""))))
    name = F.when(name.contains("://"), F.regexp_extract(name, r"^[^:]*://([^/?#:]*)", 1)).otherwise(name)
    return _first([(name.rlike(any_of(words)), label) for label, words in catalogue], default)


def route_family(family: Column, post_id: Column) -> Column:
    """Stored family, else singular for a post-backed row, else unclassified."""
    clean = F.regexp_replace(F.lower(F.coalesce(family, F.lit(""))), r"[^a-z0-9_\-]", "")
    return F.when(clean != "", clean).when(post_id > 0, "singular").otherwise("unclassified")


def revenue_route(url: Column, catalogue: Sequence[tuple] = rules.REVENUE_ROUTE_RULES) -> Column:
    """Family of a revenue path that maps to no published content."""
    raw = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    bare = F.when(raw.rlike("^https?://"), F.regexp_extract(raw, urls.SPLIT, 3)).otherwise(raw)
    rooted = F.concat(F.lit("/"), F.regexp_replace(bare, "^/+", ""))
    return _first([(rooted.rlike(regex), label) for label, regex in catalogue], "other")


def content_format(
    url: Column, categories: Column, title: Column, catalogue: Sequence[tuple] = rules.FORMAT_RULES
) -> Column:
    slugs = F.transform(categories, F.lower)
    text = F.lower(F.coalesce(title, F.lit("")))
    cases = [(F.coalesce(url.rlike(rules.LEGACY_HTML_URL), F.lit(False)), "legacy-html")]
    cases += [
        (F.arrays_overlap(slugs, F.array(*[F.lit(w) for w in words])), label) for label, words in catalogue
    ]
    cases += [
        (text.rlike(rules.FORMAT_TRIVIA_TITLE), "trivia"),
        (text.rlike(rules.FORMAT_LIST_TITLE), "listicle"),
    ]
    return _first(cases, rules.FORMAT_DEFAULT)


def format_eligible(blog_id: Column, post_type: Column, entry_blog: int = 1) -> Column:
    return F.coalesce((blog_id == entry_blog) & (post_type == "post"), F.lit(False))
