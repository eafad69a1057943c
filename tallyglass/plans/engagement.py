"""Search gaps, bridge ratio and outbound clicks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import predicates as P
from ..functions import urls
from ..functions.stats import first_rows, ratio
from .traffic import in_scope, top_values


def search_terms(
    events: DataFrame, as_of: datetime, days: int = 28, max_results: int = 0, require_visitor: bool = False, max_chars: int = 0,
    blog_id: int = 0,
) -> DataFrame:
    """Searches folded by term and source, with the attack verdict of each distinct term; all lengths unless ``max_chars``."""
    rows = in_scope(events, as_of, days, "search", blog_id).filter(
        P.bot_is_not_true() & F.col("search_term").isNotNull()
    )
    if max_chars > 0:
        rows = rows.filter(F.char_length("search_term") <= max_chars)
    if require_visitor:
        rows = rows.filter(P.identified())
    n = F.col("result_count")
    gap = n.between(0, max_results)
    # The classified text is an aggregate of its group, so no filter on it moves below.
    folded = rows.groupBy("search_term", F.coalesce("search_source", F.lit("unknown")).alias("source")).agg(
        F.max("search_term").alias("term"),
        F.count("*").alias("searches"),
        F.count_if(F.col("is_bot").isNull()).alias("unclassified"),
        F.count_if(n == 0).alias("zero_cnt"),
        F.count_if(gap).alias("gap_cnt"),
        F.count_if(gap & (n > 0)).alias("low_cnt"),
        F.min(F.when(gap, n)).alias("min_results"),
    )
    attack = F.coalesce((F.col("term") != "") & C.search_payload(F.col("term")).isNotNull(), F.lit(False))
    return folded.drop("search_term").withColumn("attack", attack)


def without_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is not listed; a NULL in the list removes nothing."""
    return rows.join(terms.select("term"), "term", "left_anti")


def search_gaps(terms: DataFrame, limit: int = 25) -> DataFrame:
    """Terms that found nothing, by searches that found nothing."""
    rows = _gap_terms(terms).filter(F.col("min_results") == 0).select("term", F.col("zero_cnt").alias("count"))
    return first_rows(rows.orderBy(F.desc("count"), "term"), limit)


def search_low_results(terms: DataFrame, limit: int = 25) -> DataFrame:
    rows = _gap_terms(terms).filter(F.col("min_results") > 0)
    rows = rows.select("term", F.col("low_cnt").alias("count"), "min_results")
    return first_rows(rows.orderBy(F.desc("count"), "term"), limit)


def _gap_terms(terms: DataFrame) -> DataFrame:
    return (
        terms.filter(~F.col("attack") & (F.col("term") != "") & (F.col("gap_cnt") > 0))
        .groupBy("term")
        .agg(
            F.min("min_results").alias("min_results"),
            F.sum("zero_cnt").alias("zero_cnt"),
            F.sum("low_cnt").alias("low_cnt"),
        )
    )


def search_by_source(terms: DataFrame) -> DataFrame:
    return (
        terms.filter(~F.col("attack"))
        .groupBy("source")
        .agg(F.sum("searches").alias("count"), F.sum("zero_cnt").alias("zero_result_count"))
        .orderBy(F.desc("count"), "source")
    )


def search_totals(terms: DataFrame) -> DataFrame:
    """Scope totals, gap totals and exclusions; empty terms stay in the search total."""
    kept = ~F.col("attack")
    named = kept & (F.col("term") != "")
    zero_terms = F.count_distinct(F.when(named & (F.col("min_results") == 0), F.col("term")))
    add = lambda cond, col: F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))
    out = terms.agg(
        add(kept, "searches").alias("total_searches"),
        add(kept, "unclassified").alias("unclassified"),
        add(named & (F.col("gap_cnt") > 0), "zero_cnt").alias("zero_result_total"),
        zero_terms.alias("zero_result_distinct"),
        add(F.col("attack"), "searches").alias("excluded_attack_searches"),
        F.count_distinct(F.when(F.col("attack"), F.col("term"))).alias("excluded_attack_terms"),
        add(kept & (F.col("term") == ""), "gap_cnt").alias("empty"),
    )
    return out.select(
        "total_searches",
        (F.col("total_searches") - F.col("unclassified")).alias("classified_human"),
        "unclassified",
        "zero_result_total",
        "zero_result_distinct",
        ratio(F.col("zero_result_total") * 100, F.col("total_searches"), 2, 0.0).alias("zero_result_rate"),
        (F.col("excluded_attack_searches") + F.col("empty")).alias("excluded_bot"),
        "excluded_attack_searches",
        "excluded_attack_terms",
    )


def _bridge_rows(events: DataFrame, as_of: datetime, days: int, blog_id: int = 0) -> DataFrame:
    rows = in_scope(events, as_of, days, None, blog_id)
    return rows.filter(P.of_type(["bridge_click", "bridge_impression"]))


def _bridge_counts() -> list:
    return [
        F.count_if(F.col("event_type") == "bridge_click").alias("clicks"),
        F.count_if(F.col("event_type") == "bridge_impression").alias("impressions"),
    ]


def bridge_ctr(events: DataFrame, as_of: datetime, days: int = 28, blog_id: int = 0) -> DataFrame:
    """Stored clicks over stored impressions per destination; the ratio may exceed 1."""
    rows = _bridge_rows(events, as_of, days, blog_id).filter(~P.bot_is_truthy())
    dest = F.coalesce(F.when(F.col("dest_site") != "", F.col("dest_site")), F.lit("(unknown)"))
    return (
        rows.groupBy(dest.alias("dest_site"))
        .agg(*_bridge_counts())
        .withColumn("ctr", ratio(F.col("clicks"), F.col("impressions"), 4, 0.0))
        .orderBy(F.desc("impressions"), F.desc("clicks"), "dest_site")
    )


def bridge_coverage(events: DataFrame, as_of: datetime, days: int = 28, blog_id: int = 0) -> DataFrame:
    human = ~P.bot_is_truthy()
    known = human & P.identified()
    out = _bridge_rows(events, as_of, days, blog_id).agg(
        F.count("*").alias("loaded_rows"),
        F.count_if(~human).alias("bot_rows_excluded"),
        F.count_if(human & (F.col("event_type") == "bridge_click")).alias("clicks"),
        F.count_if(human & (F.col("event_type") == "bridge_impression")).alias("impressions"),
        F.count_if(known).alias("identified_rows"),
        F.count_if(human & ~P.identified()).alias("anonymous_rows"),
        F.count_if(human & (F.coalesce("dest_site", F.lit("")) == "")).alias("rows_missing_dest_site"),
    )
    eligible = F.col("clicks") + F.col("impressions")
    missing = F.col("rows_missing_dest_site")
    return out.select(
        "clicks",
        "impressions",
        ratio(F.col("clicks"), F.col("impressions"), 4, 0.0).alias("ctr"),
        "loaded_rows",
        eligible.alias("eligible_rows"),
        "bot_rows_excluded",
        "identified_rows",
        "anonymous_rows",
        "rows_missing_dest_site",
        F.when(F.col("loaded_rows") == 0, "not_observed").otherwise("observed").alias("status"),
        F.when(eligible == 0, "not_observed")
        .when(missing == 0, "measured")
        .when(missing == eligible, "not_instrumented")
        .otherwise("partial")
        .alias("destination_status"),
        F.when(eligible == 0, "not_observed")
        .when(F.col("anonymous_rows") == 0, "complete")
        .when(F.col("identified_rows") == 0, "unavailable")
        .otherwise("partial")
        .alias("identity_status"),
    )


def outbound_rows(
    events: DataFrame, as_of: datetime, days: int = 28, category: str = "", include_bots: bool = False,
    blog_id: int = 0,
) -> DataFrame:
    rows = in_scope(events, as_of, days, "outbound_click", blog_id)
    if not include_bots:
        rows = rows.filter(P.explicit_human())
    dest = F.lower(F.coalesce("dest_host", F.lit("")))
    stamped = F.regexp_replace(F.lower(F.coalesce("category", F.lit(""))), r"[^a-z0-9_\-]", "")
    rows = rows.select(
        "id",
        "created_at",
        "source_url",
        dest.alias("dest_host"),
        F.when(stamped != "", stamped).otherwise(C.outbound_category(dest)).alias("category"),
    )
    return rows.filter(F.col("category") == category) if category else rows


def outbound_by_category(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("category").agg(F.count("*").alias("clicks"))
    total = grouped.agg(F.sum("clicks")).scalar()
    return grouped.withColumn("share", ratio(F.col("clicks"), total, 4)).orderBy(F.desc("clicks"), "category")


def outbound_by_destination(rows: DataFrame, limit: int = 25) -> DataFrame:
    """Hosts by clicks; a host carries the category of its earliest row."""
    return (
        rows.filter(F.col("dest_host") != "")
        .groupBy("dest_host")
        .agg(F.min_by("category", F.struct("created_at", "id")).alias("category"), F.count("*").alias("clicks"))
        .orderBy(F.desc("clicks"), "dest_host")
        .limit(limit)
    )


def outbound_by_source(rows: DataFrame, limit: int = 25) -> DataFrame:
    # Canonicalise distinct URLs only.
    folded = rows.groupBy("source_url").agg(F.count("*").alias("n"))
    return (
        folded.groupBy(urls.canonical_url(F.col("source_url")).alias("source_url"))
        .agg(F.sum("n").alias("clicks"))
        .filter(F.col("source_url") != "")
        .orderBy(F.desc("clicks"), "source_url")
        .limit(limit)
    )


def outbound_totals(rows: DataFrame) -> DataFrame:
    out = rows.agg(F.count("*").alias("total"), F.count_if(F.col("dest_host") == "").alias("rows_missing_dest_host"))
    lost = (F.col("total") > 0) & (F.col("rows_missing_dest_host") == F.col("total"))
    return out.withColumn("diagnostic", F.when(lost, "missing_destination_dimensions"))


def filter_outbound(links: DataFrame, host_col: str, own_hosts: DataFrame) -> DataFrame:
    """Links that leave the network: neither an own host nor a subdomain of one.

    Each link is expanded to its host's suffixes, so the test is an equi-join.
    """
    parts = F.split(F.lower(F.col(host_col)), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    hosts = links.groupBy(host_col).agg(F.count("*").alias("_n"))
    inside = (
        hosts.select(host_col, F.explode(suffixes).alias("_suffix"))
        .join(own_hosts.select(F.col("host").alias("_suffix")), "_suffix", "left_semi")
        .select(host_col)
        .distinct()
    )
    return links.join(inside, host_col, "left_anti")
