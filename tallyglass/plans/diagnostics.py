"""Revenue integrity checks: one row per check, worst status overall."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import half_up, ratio
from ..operators import revenue as R
from ..operators.reuse import Shared

STALE_DAYS = 45
MAX_UNRESOLVED, MAX_UNCATEGORIZED, MAX_ZERO_REVENUE = 0.50, 0.30, 0.20
RPM_DRIFT, MAX_DRIFT_ROWS, RPM_FLOOR = 0.20, 0.10, 1e-4
HIGH_RATE, MAX_VIEWS, MAX_IMPRESSIONS = 1000, 1_000_000_000, 1000
MONTH = r"^\d{4}-\d{2}$"


def _warn(cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), "warning").otherwise("pass")


def _money(col: Column) -> Column:
    return half_up(F.coalesce(col, F.lit(0).cast("decimal(28,4)")), 4)


def _named(check: str, frame: DataFrame) -> DataFrame:
    return frame.select(F.lit(check).alias("check"), *frame.columns)


def missing_periods(rows: DataFrame) -> DataFrame:
    """Months absent between the first and the last YYYY-MM label."""
    seen = rows.filter(F.col("period_label").rlike(MONTH)).groupBy("period_label").agg(F.count("*").alias("n"))
    first_day = F.concat("period_label", F.lit("-01")).try_cast("date")
    months = seen.agg(F.min(first_day).alias("a"), F.max(first_day).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")
    ).select(F.date_format("m", "yyyy-MM").alias("period_label"))
    return months.join(seen, "period_label", "left_anti")


class Diagnostics(Shared):
    """``rows`` are raw revenue rows, ``pages`` the same rows folded and resolved.

    All row checks share one pass over the rows, all page checks one over the pages;
    what the single checks read are one-row tables.
    """

    def __init__(self, rows: DataFrame, pages: DataFrame, as_of: date):
        super().__init__()
        self.rows, self.as_of, self._pages = rows, as_of, pages

    def pages(self) -> DataFrame:
        cols = [
            "slug", "source_url", "rows", "views", "revenue", "positive_revenue", "stored_post_id", "is_content", "page_key",
            "format", "editorial", "route_family", "serve_ads", "conflict_rows",
        ]
        return self.keep("pages", lambda: self._pages.select(*cols))

    def periods(self) -> DataFrame:
        return self.keep("periods", lambda: R.batches(self.rows))

    def row_stats(self) -> DataFrame:
        return self.keep("row_stats", self._row_stats)

    def page_stats(self) -> DataFrame:
        return self.keep("page_stats", self._page_stats)

    def _row_stats(self) -> DataFrame:
        views, revenue = F.col("views"), F.col("revenue")
        unseen, unpaid = (views <= 0) & (revenue > 0), (views > 0) & (revenue <= 0)
        source = F.coalesce("rpm", F.lit(0.0))
        drift = F.abs(F.col("derived_rpm") - source) / F.greatest(F.abs(source), F.lit(RPM_FLOOR)) > RPM_DRIFT
        blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
        return self._judged().agg(
            F.count("*").alias("rows"),
            F.coalesce(F.sum(views), F.lit(0)).alias("views"),
            _money(F.sum(revenue)).alias("revenue"),
            F.count_if(unseen).alias("unseen_rows"),
            _money(F.sum(F.when(unseen, revenue))).alias("unseen_revenue"),
            F.count_if(unpaid).alias("unpaid_rows"),
            F.coalesce(F.sum(F.when(unpaid, views)), F.lit(0)).alias("unpaid_views"),
            F.count_if("bad").alias("bad_rows"),
            F.count_if("high_rate").alias("high_rate_rows"),
            F.count_if(views > 0).alias("viewed_rows"),
            F.count_if((views > 0) & drift).alias("divergent_rows"),
            F.count_if(blank("import_batch")).alias("missing_batch"),
            F.count_if(blank("period_label")).alias("missing_period"),
        )

    def _page_stats(self) -> DataFrame:
        """Sums per page first: counting pages then counts rows, without a distinct count that expands them."""
        content, n = F.col("is_content"), F.col("rows")
        known = F.col("serve_ads").isNotNull()
        zero = lambda col: F.coalesce(F.sum(col), F.lit(0))
        per_page = self.pages().groupBy("page_key", "is_content").agg(
            F.sum(n).alias("n"),
            F.sum(F.when(~content & (F.col("stored_post_id") > 0), n)).alias("stale"),
            F.sum("views").alias("views"),
            F.sum("revenue").alias("revenue"),
            F.sum(F.when(known, n)).alias("known"),
            F.sum(F.when(~known, n)).alias("unknown"),
            F.sum("conflict_rows").alias("conflicts"),
            F.sum(F.when(~F.col("serve_ads"), F.col("positive_revenue"))).alias("conflict_revenue"),
        )
        return per_page.agg(
            zero("n").alias("raw_rows"),
            F.count("page_key").alias("total_pages"),  # a page is content or not, never both
            F.count(F.when(content, F.col("page_key"))).alias("resolved_pages"),
            F.count(F.when(~content, F.col("page_key"))).alias("unresolved_pages"),
            zero(F.when(content, F.col("n"))).alias("content_rows"),
            zero(F.when(~content, F.col("n"))).alias("unresolved_rows"),
            zero("stale").alias("stale_post_id_rows"),
            zero("views").alias("partition_views"),
            _money(F.sum("revenue")).alias("partition_revenue"),
            zero(F.when(content, F.col("views"))).alias("resolved_views"),
            zero(F.when(~content, F.col("views"))).alias("unresolved_views"),
            zero("known").alias("instrumented_rows"),
            zero("unknown").alias("unknown_rows"),
            zero("conflicts").alias("conflict_rows"),
            _money(F.sum("conflict_revenue")).alias("conflict_revenue"),
        )

    def freshness(self) -> DataFrame:
        out = self.periods().agg(
            F.count("*").alias("periods"),
            F.max("period_end").alias("latest_period_end"),
            F.min_by(
                "period_label",
                F.when(F.col("period_end").isNotNull(),
                       F.struct(F.datediff(F.lit(self.as_of), F.col("period_end")).alias("age"), F.col("period_label"))),
            ).alias("latest_period"),
        )
        age = F.datediff(F.lit(self.as_of), F.col("latest_period_end"))
        status = (
            F.when(F.col("periods") == 0, "fail")
            .when(F.col("latest_period_end").isNull() | (age > STALE_DAYS), "warning")
            .otherwise("pass")
        )
        return _named("latest_period_freshness", out.select(
            status.alias("status"), "periods", "latest_period", "latest_period_end", age.alias("data_age_days")
        ))

    def missing(self) -> DataFrame:
        gaps = missing_periods(self.periods()).agg(
            F.count("*").alias("missing_periods"), F.array_join(F.array_sort(F.collect_list("period_label")), ",").alias("missing")
        )
        dated = self.periods().filter(F.col("period_label").rlike(MONTH)).agg(F.count_distinct("period_label")).scalar()
        return _named("missing_periods", gaps.select(
            _warn(F.col("missing_periods") > 0).alias("status"), dated.alias("dated_periods"), "missing_periods", "missing"
        ))

    def duplicate_batches(self) -> DataFrame:
        per = self.periods().filter(F.col("period_label") != "").groupBy("period_label").agg(
            F.count_distinct("import_batch").alias("n")
        )
        out = per.agg(F.count("*").alias("period_labels"), F.count_if(F.col("n") > 1).alias("duplicate_labels"))
        return _named("duplicate_period_batches", out.select(
            _warn(F.col("duplicate_labels") > 0).alias("status"), "period_labels", "duplicate_labels"
        ))

    def reconciliation(self) -> DataFrame:
        """Row sums after resolution against the snapshot list's sums."""
        by_row = self.page_stats().select(
            F.col("raw_rows").alias("row_rows"), F.col("partition_views").alias("row_views"),
            F.col("partition_revenue").alias("row_revenue"),
        )
        other = self.periods().agg(
            F.struct(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
                _money(F.sum(F.col("revenue").cast("decimal(28,4)"))).alias("revenue"),
            )
        ).scalar()
        out = by_row.select(
            "*", other["rows"].alias("independent_rows"), other["views"].alias("independent_views"),
            other["revenue"].alias("independent_revenue"),
        )
        same = (
            (F.col("row_rows") == F.col("independent_rows"))
            & (F.col("row_views") == F.col("independent_views"))
            & (F.abs(F.col("row_revenue") - F.col("independent_revenue")) < 0.01)
        )
        empty = (F.col("row_rows") == 0) & (F.col("independent_rows") == 0)
        status = F.when(empty, "warning").when(same, "pass").otherwise("fail")
        return _named("totals_reconciliation", out.select(status.alias("status"), "*"))

    def partition(self) -> DataFrame:
        out = self.page_stats().select(
            "raw_rows", "resolved_pages", "unresolved_pages", "content_rows", "unresolved_rows", "stale_post_id_rows",
            "partition_views", "partition_revenue",
        )
        complete = F.col("content_rows") + F.col("unresolved_rows") == F.col("raw_rows")
        status = F.when(~complete, "fail").otherwise(_warn(F.col("stale_post_id_rows") > 0))
        return _named("content_unresolved_reconciliation", out.select(
            status.alias("status"), complete.alias("partition_complete"), "*"
        ))

    def resolution(self) -> DataFrame:
        out = self.page_stats().select(
            "total_pages", "resolved_pages", "unresolved_pages", "resolved_views", "unresolved_views"
        )
        share = F.col("unresolved_pages") / F.when(F.col("total_pages") > 0, F.col("total_pages"))
        return _named("resolution_coverage", out.select(
            _warn(share > MAX_UNRESOLVED).alias("status"), "*",
            ratio(F.col("unresolved_pages"), F.col("total_pages"), 4, 0.0).alias("unresolved_ratio"),
        ))

    def resolution_by_route(self) -> DataFrame:
        """Distinct unresolved pages per route family, each page in the family of its first URL."""
        pages = self.pages().filter(~F.col("is_content")).groupBy("page_key").agg(
            F.min_by("route_family", "source_url").alias("route_family")
        )
        return pages.groupBy("route_family").agg(F.count("*").alias("pages"))

    def format_pages(self) -> DataFrame:
        return self.pages().filter("is_content").groupBy("page_key", "editorial").agg(F.max("format").alias("format"))

    def formats(self) -> DataFrame:
        out = self.format_pages().agg(
            F.count("*").alias("resolved_pages"),
            F.count_if("editorial").alias("eligible_editorial_pages"),
            F.count_if(~F.col("editorial")).alias("non_editorial_pages"),
            F.count_if(F.col("editorial") & (F.col("format") == "uncategorized")).alias("uncategorized_pages"),
        )
        n, total = F.col("uncategorized_pages"), F.col("eligible_editorial_pages")
        return _named("format_coverage", out.select(
            _warn(n / F.when(total > 0, total) > MAX_UNCATEGORIZED).alias("status"), "*",
            ratio(n, total, 4, 0.0).alias("uncategorized_ratio"),
        ))

    def zero_view_rows(self, limit: int = 5) -> DataFrame:
        """A few examples, largest revenue first."""
        rows = self.rows.filter((F.col("views") <= 0) & (F.col("revenue") > 0))
        return rows.select("slug", "period_label", "import_batch", "revenue").orderBy(
            F.desc("revenue"), "slug", "period_label", "import_batch"
        ).limit(limit)

    def zero_views(self) -> DataFrame:
        out = self.row_stats().select(
            F.col("unseen_rows").alias("rows"), F.col("unseen_revenue").alias("revenue")
        )
        return _named("zero_view_revenue", out.select(_warn(F.col("rows") > 0).alias("status"), "*"))

    def zero_revenue(self) -> DataFrame:
        out = self.row_stats().select(
            F.col("unpaid_rows").alias("rows"), F.col("unpaid_views").alias("views"), F.col("rows").alias("_n")
        )
        share = F.col("rows") / F.when(F.col("_n") > 0, F.col("_n"))
        return _named("views_zero_revenue", out.select(
            _warn(share > MAX_ZERO_REVENUE).alias("status"), "rows", "views",
            ratio(F.col("rows"), F.col("_n"), 4, 0.0).alias("ratio"),
        ))

    def _derived_rpm(self) -> Column:
        return R.per_thousand(F.col("revenue"), F.col("views"), 4)

    def issues(self) -> DataFrame:
        """Rows with the list of impossible values each holds."""
        bad, high = self._tests()
        codes = F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in bad]), lambda c: c.isNotNull())
        return self.rows.select("slug", "period_label", "import_batch", codes.alias("issues"), high.alias("high_rate"))

    def _judged(self) -> DataFrame:
        """Rows with the verdicts alone, which stay inside generated code."""
        bad, high = self._tests()
        wrong = reduce(lambda a, b: a | b, [F.coalesce(cond, F.lit(False)) for _, cond in bad])
        return self.rows.select(
            "period_label", "import_batch", "views", "revenue", "rpm", self._derived_rpm().alias("derived_rpm"),
            wrong.alias("bad"), high.alias("high_rate"),
        )

    def _tests(self) -> tuple[list[tuple[str, Column]], Column]:
        rate = {
            "revenue": F.col("revenue").cast("double"), "source_rpm": F.col("rpm"), "derived_rpm": self._derived_rpm(),
            "cpm": F.col("cpm"), "viewability": F.col("viewability"), "fill_rate": F.col("fill_rate"),
            "impressions_per_pageview": F.col("impressions_per_pageview"),
        }
        rate = {k: F.coalesce(v, F.lit(0.0)) for k, v in rate.items()}
        bad = [(f"non_finite_{k}", F.isnan(v) | (F.abs(v) == float("inf"))) for k, v in rate.items()]
        bad += [("negative_views", F.col("views") < 0), ("high_views", F.col("views") > MAX_VIEWS)]
        bad += [(f"negative_{k}", rate[k] < 0) for k in ("revenue", "source_rpm", "derived_rpm", "cpm")]
        bad += [(f"{k}_out_of_range", ~rate[k].between(0, 100)) for k in ("viewability", "fill_rate")]
        bad += [("impressions_out_of_range", ~rate["impressions_per_pageview"].between(0, MAX_IMPRESSIONS))]
        high = [rate[k] > HIGH_RATE for k in ("source_rpm", "derived_rpm", "cpm")]
        return bad, reduce(lambda a, b: a | b, high)

    def impossible(self) -> DataFrame:
        out = self.row_stats().select("bad_rows", "high_rate_rows")
        status = F.when(F.col("bad_rows") > 0, "fail").otherwise(_warn(F.col("high_rate_rows") > 0))
        return _named("negative_impossible_values", out.select(status.alias("status"), "*"))

    def rpm_variance(self) -> DataFrame:
        out = self.row_stats().select("viewed_rows", "divergent_rows")
        share = F.col("divergent_rows") / F.when(F.col("viewed_rows") > 0, F.col("viewed_rows"))
        return _named("rpm_variance", out.select(
            _warn(share > MAX_DRIFT_ROWS).alias("status"), "*",
            ratio(F.col("divergent_rows"), F.col("viewed_rows"), 4, 0.0).alias("ratio"),
        ))

    def provenance(self) -> DataFrame:
        out = self.row_stats().select("rows", "missing_batch", "missing_period")
        lacking = F.col("missing_batch") + F.col("missing_period") > 0
        return _named("provenance_coverage", out.select(_warn(lacking).alias("status"), "*"))

    def ad_policy(self) -> DataFrame:
        out = self.page_stats().select("instrumented_rows", "unknown_rows", "conflict_rows", "conflict_revenue")
        return _named("ad_policy_consistency", out.select(
            _warn((F.col("conflict_rows") > 0) | (F.col("unknown_rows") > 0)).alias("status"), "*"
        ))

    CHECKS = (
        "freshness", "missing", "duplicate_batches", "reconciliation", "partition", "resolution", "formats",
        "zero_views", "zero_revenue", "impossible", "rpm_variance", "provenance", "ad_policy",
    )

    def report(self) -> DataFrame:
        """All checks as (check, status)."""
        return reduce(
            DataFrame.unionByName, [getattr(self, name)().select("check", "status") for name in self.CHECKS]
        )

    def overall(self) -> DataFrame:
        out = self.report().agg(
            F.count_if(F.col("status") == "pass").alias("passed"),
            F.count_if(F.col("status") == "warning").alias("warnings"),
            F.count_if(F.col("status") == "fail").alias("failed"),
            F.count("*").alias("total"),
        )
        worst = F.when(F.col("failed") > 0, "fail").when(F.col("warnings") > 0, "warning").otherwise("pass")
        return out.withColumn("overall_status", worst)
