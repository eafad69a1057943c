"""DuckDB spellings of the rule catalogues."""

from __future__ import annotations

from ..functions import rules as R
from ..functions.classify import any_of


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def first(cases: list[tuple[str, str]], default: str | None) -> str:
    arms = " ".join(f"WHEN {cond} THEN {lit(label)}" for cond, label in cases)
    tail = "" if default is None else f" ELSE {lit(default)}"
    return f"CASE {arms}{tail} END"


def category_404(url: str) -> str:
    low = f"lower({url})"
    tests = {
        "re": lambda p: matches(url, p),
        "re_decoded": lambda p: f"({matches(url, p)} OR {matches(f'url_decode({url})', p)})",
        "path_lower": lambda p: f"rtrim({low}, '/') IN ({', '.join(map(lit, p))})",
        "equals_lower": lambda p: f"{low} IN ({', '.join(map(lit, p))})",
        "prefix": lambda p: "(" + " OR ".join(f"starts_with({url}, {lit(x)})" for x in p) + ")",
        "prefix_lower": lambda p: "(" + " OR ".join(f"starts_with({low}, {lit(x)})" for x in p) + ")",
    }
    return first([(tests[kind](p), label) for label, kind, p in R.NOT_FOUND_RULES], R.NOT_FOUND_DEFAULT)


def members(expr: str, words: list[str]) -> str:
    return f"{expr} IN ({', '.join(map(lit, words))})"


def unslash(term: str) -> str:
    return rf"regexp_replace({term}, '\\(.)', '\1', 'g')"


def decoded(term: str) -> str:
    text = unslash(term)
    for entity, char in R.HTML_ENTITIES:
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    for _ in range(3):
        text = f"url_decode({text})"
    return text


def payload(raw: str, clean: str, part: str) -> str:
    """One field of the search-payload verdict over prepared raw and decoded text."""
    arms = []
    for name, family, regex, on_raw in R.SEARCH_PAYLOAD_RULES:
        text = raw if on_raw else clean
        value = {
            "pattern_name": lit(name),
            "pattern_family": lit(family),
            "matched_token": f"substr(regexp_extract({text}, {lit(regex)}, 0), 1, 120)",
        }[part]
        arms.append(f"WHEN {matches(text, regex)} THEN {value}")
    return f"CASE {' '.join(arms)} END"


def substring_rules(expr: str, catalogue, default: str) -> str:
    return first(
        [("(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")", label) for label, words in catalogue],
        default,
    )


def ua_class(ua: str) -> str:
    text = f"coalesce({ua}, '')"
    hits = " OR ".join(f"contains(lower({text}), {lit(w)})" for w in R.BOT_UA_SUBSTRINGS)
    return f"CASE WHEN trim({text}) = '' THEN 'empty' WHEN {hits} THEN 'bot' ELSE 'browser' END"


def content_format(url: str, slugs: str, title: str) -> str:
    cases = [(f"coalesce({matches(url, R.LEGACY_HTML_URL)}, false)", "legacy-html")]
    cases += [
        (f"list_has_any({slugs}, [{', '.join(map(lit, words))}])", label) for label, words in R.FORMAT_RULES
    ]
    cases += [
        (matches(f"lower({title})", R.FORMAT_TRIVIA_TITLE), "trivia"),
        (matches(f"lower({title})", R.FORMAT_LIST_TITLE), "listicle"),
    ]
    return first(cases, R.FORMAT_DEFAULT)


SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def host(url: str) -> str:
    bare = rf"regexp_replace(regexp_replace(regexp_extract({url}, '{SPLIT}', 2), '^.*@', ''), ':\d*$', '')"
    return rf"lower(regexp_replace({bare}, '\.+$', ''))"


def canonical_url(url: str) -> str:
    t = f"trim(coalesce({url}, ''))"
    path = lambda p: f"regexp_replace(concat('/', {p}), '/+', '/', 'g')"
    rel = path(f"regexp_extract({t}, '^([^?#]*)', 1)")
    absolute = path(f"regexp_extract({t}, '{SPLIT}', 3)")
    port = rf"regexp_extract(regexp_extract({t}, '{SPLIT}', 2), '(:\d+)$', 1)"
    scheme = f"lower(regexp_extract({t}, '{SPLIT}', 1))"
    return (
        f"CASE WHEN {t} = '' THEN '' WHEN starts_with({t}, '/') AND NOT starts_with({t}, '//') THEN {rel} "
        f"WHEN {scheme} NOT IN ('http', 'https') OR {host(t)} = '' OR regexp_matches({host(t)}, '[\\s@]') THEN '' "
        f"ELSE concat({scheme}, '://', {host(t)}, {port}, {absolute}) END"
    )


def route_family(family: str, post: str) -> str:
    clean = rf"regexp_replace(lower(coalesce({family}, '')), '[^a-z0-9_\-]', '', 'g')"
    return f"CASE WHEN {clean} <> '' THEN {clean} WHEN {post} > 0 THEN 'singular' ELSE 'unclassified' END"


def revenue_route(url: str) -> str:
    raw = f"lower(trim(coalesce({url}, '')))"
    bare = f"CASE WHEN regexp_matches({raw}, '^https?://') THEN regexp_extract({raw}, '{SPLIT}', 3) ELSE {raw} END"
    rooted = f"concat('/', regexp_replace({bare}, '^/+', ''))"
    return first([(matches(rooted, rx), label) for label, rx in R.REVENUE_ROUTE_RULES], "other")
