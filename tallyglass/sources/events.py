"""Event tables: decode, write-time stamps, admission of public writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import predicates as P
from ..functions import urls
from ..operators.anchors import IDENTIFIER, MAX_VERSION
from ..operators.skew import heavy_lookup

BRONZE = (
    "id bigint, event_type string, event_data string, source_url string, blog_id int, user_id bigint, "
    "visitor_id string, created_at timestamp"
)
PAYLOAD = {
    "user_id": "bigint", "is_bot": "string", "post_id": "bigint", "route_family": "string", "view_kind": "string",
    "referrer_host": "string", "context": "string", "search_term": "string", "result_count": "bigint",
    "source": "string", "classification": "string", "pattern_family": "string", "matched_token": "string",
    "ip": "string", "user_agent": "string", "requested_url": "string", "referer": "string", "ip_hash": "string",
    "dest_site": "string", "source_post": "bigint", "source_site": "string", "term": "string", "dest_host": "string",
    "dest_url": "string", "category": "string", "experiment_key": "string", "definition_version": "bigint",
    "assignment_policy": "string", "variant": "string", "surface": "string", "recipient_count": "bigint",
    "error_code": "string",
}
RENAMED = {"user_id": "payload_user_id", "source": "search_source"}


def payload_field(name: str, kind: str = "string", col: str = "event_data") -> Column:
    """One payload value; JSON null, a missing key and broken JSON all read as NULL."""
    text = F.get_json_object(col, f"$.{name}")
    return text if kind == "string" else text.try_cast(kind)


def decode_events(bronze: DataFrame) -> DataFrame:
    """Typed event columns from the JSON payload."""
    fields = [payload_field(n, k).alias(RENAMED.get(n, n)) for n, k in PAYLOAD.items()]
    day = ["event_date"] if "event_date" in bronze.columns else []
    return bronze.select(
        "id", "event_type", "source_url", "blog_id", "user_id", "visitor_id", "created_at", *day,
        F.unix_timestamp("created_at").alias("ts"), *fields,
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Typed view of the table that :func:`append_events` writes; ``event_date`` stays, so windows prune days."""
    return decode_events(spark.read.schema(f"{BRONZE}, event_date date").parquet(path))


def canonical_type(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"[^a-z0-9_\-]", "")


def stamp_events(raw: DataFrame) -> DataFrame:
    """Write-time stamps on typed rows with ``user_agent`` and ``request_origin``.

    Untyped rows are dropped, a visitor must be a UUID v4, hostile searches become
    ``search_attack`` rows that carry their pattern.
    """
    rows = raw.withColumn("event_type", canonical_type(F.col("event_type"))).filter(F.col("event_type") != "")
    rows = rows.withColumn("visitor_id", F.when(P.valid_uuid4(), F.col("visitor_id")))
    seen = C.verdict(
        F.col("user_agent"), F.col("visitor_id").isNotNull(), F.col("request_origin"), F.coalesce("user_id", F.lit(0)) > 0
    )
    searching = F.col("event_type") == "search"
    attack = F.when(searching, C.search_payload(F.col("search_term")))
    rows = rows.withColumn("_attack", attack).withColumn("is_bot", seen["is_bot"].cast("string"))
    return rows.select(
        *[c for c in raw.columns if c not in ("event_type", "source_url", "request_origin", "is_bot", "search_source")],
        F.when(F.col("_attack").isNotNull(), "search_attack").otherwise(F.col("event_type")).alias("event_type"),
        urls.canonical_url(F.col("source_url")).alias("source_url"),
        F.when(searching, C.search_source(F.col("source_url"))).alias("search_source"),
        "is_bot",
        F.col("_attack.pattern_name").alias("classification"),
        F.col("_attack.pattern_family").alias("pattern_family"),
        F.col("_attack.matched_token").alias("matched_token"),
    )


def append_events(stamped: DataFrame, path: str) -> None:
    """Appends by day; the rebalance hint sizes files and splits a day that is too large."""
    dated = stamped.withColumn("event_date", F.to_date("created_at")).hint("rebalance", "event_date")
    dated.sortWithinPartitions("event_date", "event_type", "created_at").write.mode("append").partitionBy(
        "event_date"
    ).parquet(path)


# ---- admission ------------------------------------------------------------------------

CONTRACTS: dict[str, dict[str, tuple[str, int]]] = {
    "share_click": {"destination": ("string", 64), "share_url": ("string", 2048)},
    "bridge_click": {
        "dest_site": ("string", 64), "source_post": ("integer", 0), "source_site": ("string", 64), "term": ("string", 200),
    },
    "outbound_click": {"dest_host": ("string", 253), "dest_url": ("string", 2048), "category": ("string", 32)},
}
CONTRACTS["bridge_impression"] = CONTRACTS["bridge_click"]
URL_FIELDS = ("dest_url", "share_url")


def _value(name: str) -> Column:
    return F.get_json_object("event_data", f"$.{name}")


def _kind(name: str) -> Column:
    """JSON type of one field as Spark names it; NULL or VOID when there is no value."""
    return F.schema_of_variant(F.try_variant_get(F.col("_json"), f"$.{name}", "variant"))


def _bad_fields(contract: dict[str, tuple[str, int]]) -> Column:
    tests = []
    for name, (kind, length) in contract.items():
        present = _value(name).isNotNull()
        if kind == "integer":
            tests.append(present & ~_value(name).rlike(r"^\d+$"))
        else:
            tests.append(present & (~_kind(name).startswith("STRING") | (F.octet_length(_value(name)) > length)))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def admission(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` (NULL when admitted) to raw browser events.

    ``rows`` carry event_type, event_data, source_url and origin_host; ``sites`` list
    the network's (host, site).
    """
    hosts = sites.select(F.lower("host").alias("_host"), F.lit(True).alias("_own")).distinct()
    keys = sites.select(F.col("site").alias("_site"), F.lit(True).alias("_site_ok")).distinct()
    typ = F.col("event_type")
    rows = rows.withColumn("_json", F.try_parse_json("event_data")).withColumn(
        "_keys", F.json_object_keys("event_data")
    ).withColumn("_dest", _value("dest_site")).withColumn("_canonical", urls.canonical_url(F.col("source_url"))).withColumn(
        "_link", F.coalesce(*[_value(f) for f in URL_FIELDS], F.lit(""))
    )
    allowed, bad = F.lit(None).cast("array<string>"), F.lit(False)
    for name, contract in CONTRACTS.items():
        allowed = F.when(typ == name, F.array(*[F.lit(f) for f in (*contract, "is_bot")])).otherwise(allowed)
        bad = F.when(typ == name, _bad_fields(contract)).otherwise(bad)
    claimed = urls.host(F.col("_canonical"))
    own = (
        F.when((claimed != "") & (claimed != F.lower("origin_host")), "invalid_event_source")
        .when(F.col("_canonical") == "", "invalid_event_source")
        .when(F.col("_keys").isNull(), "invalid_event_data")
        .when(F.size(F.array_except("_keys", allowed)) > 0, "unsupported_field")
        .when(bad, "invalid_event_field")
        .when((F.col("_link") != "") & (urls.canonical_url(F.col("_link")) == ""), "invalid_url")
    )
    # What a row tells by itself is judged before the lookups, so that no parsed payload is shuffled.
    rows = rows.withColumn("_flaw", own).drop("_json", "_keys", "_link")
    # Most browser events come from a handful of hosts: only those are split over tasks.
    any_row = [F.monotonically_increasing_id()]
    rows = rows.withColumn("_host", F.lower("origin_host")).withColumn("_site", F.col("_dest"))
    hosted = heavy_lookup(rows, hosts, "_host", any_row, "left")
    found = heavy_lookup(hosted, keys, "_site", any_row, "left", counted=rows)
    reason = (
        F.when(~typ.isin(*CONTRACTS), "unsupported_type")
        .when(F.col("_own").isNull(), "invalid_event_origin")
        .when(F.col("_flaw").isNotNull(), F.col("_flaw"))
        .when((F.coalesce("_dest", F.lit("")) != "") & F.col("_site_ok").isNull(), "unknown_site")
    )
    return found.withColumn("reject_reason", reason)


def admit_events(rows: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with a clean payload, rejected rows with their reason)."""
    return split_admitted(admission(rows, sites), rows.columns)


def split_admitted(judged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`admission` as accepted and rejected ones; ``columns`` are those of the raw rows."""
    fields = {n: k for c in CONTRACTS.values() for n, (k, _) in c.items()}
    clean = []
    for name, kind in fields.items():
        value = _value(name)
        if name in URL_FIELDS:
            value = F.when(value != "", urls.canonical_url(value)).otherwise(value)
        clean.append((value.try_cast("bigint") if kind == "integer" else value).alias(name))
    base = [c for c in columns if c not in ("event_data", "source_url")]
    accepted = judged.filter(F.col("reject_reason").isNull()).select(
        *base, F.to_json(F.struct(*clean)).alias("event_data"), F.col("_canonical").alias("source_url")
    )
    return accepted, judged.filter(F.col("reject_reason").isNotNull()).select(*columns, "reject_reason")


EXPERIMENT_FIELDS = ["experiment_key", "definition_version", "assignment_policy", "variant", "surface"]


def admit_experiment_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exactly the five contract fields, valid identifiers and version, a known identity."""
    keys = F.array_sort(F.array_except(F.json_object_keys("event_data"), F.array(F.lit("is_bot"))))
    version = _value("definition_version")
    names = [_value(f) for f in EXPERIMENT_FIELDS if f != "definition_version"]
    named = reduce(lambda a, b: a & b, [F.coalesce(n.rlike(IDENTIFIER), F.lit(False)) for n in names])
    whole = F.coalesce(version.rlike(r"^\d+$") & version.try_cast("bigint").between(1, MAX_VERSION), F.lit(False))
    reason = (
        F.when(keys.isNull() | (keys != F.array(*[F.lit(f) for f in sorted(EXPERIMENT_FIELDS)])), "invalid_fields")
        .when(~named, "invalid_identifier")
        .when(~whole, "invalid_version")
        .when(~P.identified() & (F.coalesce("user_id", F.lit(0)) <= 0), "no_identity")
    )
    judged = rows.withColumn("reject_reason", reason)
    return judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"), judged.filter(
        F.col("reject_reason").isNotNull()
    )
