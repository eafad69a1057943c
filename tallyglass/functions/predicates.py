"""Row predicates over the event model.

The payload flag ``is_bot`` is kept as its JSON text (``'true'``, ``'false'`` or
NULL) because reports read it in four different ways.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID4 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def of_type(types: str | Iterable[str], col: str = "event_type") -> Column:
    types = [types] if isinstance(types, str) else list(types)
    return F.col(col) == types[0] if len(types) == 1 else F.col(col).isin(types)


def scoped(blog_id: int = 0, user_id: int = 0) -> Column:
    """Blog and user equality; 0 means all."""
    cond = F.lit(True)
    if blog_id > 0:
        cond = cond & (F.col("blog_id") == blog_id)
    if user_id > 0:
        cond = cond & (F.col("user_id") == user_id)
    return cond


def payload_contains(text: str, col: str = "event_data") -> Column:
    """Literal substring search; wildcard characters in ``text`` stand for themselves."""
    return F.col(col).contains(text)


def bot_is_true(flag: str = "is_bot") -> Column:
    return F.coalesce(F.col(flag) == "true", F.lit(False))


def bot_is_not_true(flag: str = "is_bot") -> Column:
    return ~bot_is_true(flag)


def bot_unclassified(flag: str = "is_bot") -> Column:
    return F.col(flag).isNull()


def explicit_human(flag: str = "is_bot") -> Column:
    return F.coalesce(F.col(flag) == "false", F.lit(False))


def bot_is_truthy(flag: str = "is_bot") -> Column:
    """True for every stamped value but the empty ones."""
    return F.coalesce(~F.col(flag).isin("false", "0", "", "[]", "null", "0.0"), F.lit(False))


def identified(visitor: str = "visitor_id") -> Column:
    return F.coalesce(F.col(visitor) != "", F.lit(False))


def valid_uuid4(col: str = "visitor_id") -> Column:
    return F.coalesce(F.col(col).rlike(UUID4), F.lit(False))


def automatic_signup() -> Column:
    """Newsletter rows written by registration itself."""
    return (F.col("event_type") == "newsletter_signup") & F.coalesce(
        F.col("context") == "registration", F.lit(False)
    )


def after(ts: Column, row_id: Column, cursor_ts: Column, cursor_id: Column) -> Column:
    """Strict (ts, id) order."""
    return (ts > cursor_ts) | ((ts == cursor_ts) & (row_id > cursor_id))
