"""Ordered pages, totals, first matches and key lookups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanspark.plans.durable import settle
from gleanspark.plans.skew import fits_broadcast, lookup_join

# Rows a top-k page may hold back before the page is cut from a distributed sort instead.
SHALLOW_ROWS = 100_000

_POS = "__pos"
_PART = "__part"
_START = "__start"
_RANK = "__rank"
_WITH_QUANTILES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
_QUANTILE_ACCURACY = 10_000
_QUANTILE_SLACK = 0.002  # of the rows, on either side; well above 1 / accuracy
_PART_BITS = 33  # monotonically_increasing_id: partition number above, row number below


class Order(NamedTuple):
    """One column of a sort order."""

    name: str
    descending: bool = False
    nulls_first: bool = True

    def column(self) -> Column:
        value = F.col(self.name)
        if self.descending:
            return value.desc_nulls_first() if self.nulls_first else value.desc_nulls_last()
        return value.asc_nulls_first() if self.nulls_first else value.asc_nulls_last()

    def after(self, last) -> Column:
        """Whether a row sorts strictly behind the value ``last``."""
        value = F.col(self.name)
        if last is None:
            return value.isNotNull() if self.nulls_first else F.lit(False)
        behind = value < F.lit(last) if self.descending else value > F.lit(last)
        return F.coalesce(behind, F.lit(not self.nulls_first))


def after_row(order: Sequence[Order], last: Sequence, inclusive: bool = False) -> Column:
    """Whether a row sorts behind the row with the order values ``last`` (or beside it)."""
    condition = F.lit(inclusive)
    for part, value in reversed(list(zip(order, last, strict=True))):
        condition = part.after(value) | (F.col(part.name).eqNullSafe(F.lit(value)) & condition)
    return condition


def newest_order(order_col: str, tie: str | None, nulls: str = "last") -> list[Order]:
    """Newest first with NULLs where the caller wants them and ties broken by key."""
    if nulls not in ("first", "last"):
        raise ValueError("nulls must be 'first' or 'last'")
    order = [Order(order_col, True, nulls == "first")]
    if tie and tie != order_col:
        order.append(Order(tie))
    return order


def newest_first(order_col: str, tie: str | None, nulls: str = "last") -> list[Column]:
    """``newest_order`` as sort columns."""
    return [part.column() for part in newest_order(order_col, tie, nulls)]


def check_page(skip: int, limit: int) -> None:
    if skip < 0 or limit < 0:
        raise ValueError("skip and limit must not be negative")


def _ranked(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """The frame with each row's position in the order, ``__rank``, counted from 0.

    The rows are range-sorted over the cluster and settled; the row counts of the sorted
    partitions, one row per partition, give each partition's first position.
    """
    placed = settle(df.orderBy(*columns).withColumn(_POS, F.monotonically_increasing_id()))
    part = F.shiftright(_POS, _PART_BITS).alias(_PART)
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_START))
    rank = F.col(_START) + F.col(_POS).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return placed.withColumn(_PART, part).join(F.broadcast(starts), _PART).select(*df.columns, rank.alias(_RANK))


def _cut(df: DataFrame, columns: Sequence[Column], skip: int, limit: int) -> DataFrame:
    """A slice by position, for one that is no page but a large part of the table."""
    rank = F.col(_RANK)
    return _ranked(df, columns).where((rank >= skip) & (rank < skip + limit)).orderBy(rank).select(*df.columns)


def _near(df: DataFrame, order: Sequence[Order], skip: int) -> tuple[DataFrame, int]:
    """Rows around position ``skip``, and how many rows sort before all of them.

    Approximate quantiles of the leading column, which need no shuffle of rows, bound a small
    stretch around the position; exact counts then prove that it holds the position. Where
    it does not, or the column has no quantiles, the whole frame is returned.
    """
    lead = order[0]
    value = F.col(lead.name)
    if not isinstance(df.schema[lead.name].dataType, _WITH_QUANTILES):
        return df, 0
    sizes = df.agg(F.count(F.lit(1)).alias("all"), F.count(value).alias("known")).first()
    known = sizes["known"]
    place = skip - (sizes["all"] - known if lead.nulls_first else 0)
    if not 0 <= place < known:
        return df, 0
    slack = known * _QUANTILE_SLACK
    from_start = [max(place - slack, 0) / known, min((place + slack) / known, 1.0)]
    shares = [1 - share for share in from_start] if lead.descending else from_start
    first, last = df.agg(F.percentile_approx(value, shares, _QUANTILE_ACCURACY).alias("q")).first()["q"]
    behind_first = lead.after(first) | value.eqNullSafe(F.lit(first))
    stretch = behind_first & ~lead.after(last)
    counted = df.agg(F.count_if(~behind_first).alias("before"), F.count_if(stretch).alias("rows")).first()
    if not counted["before"] <= skip < counted["before"] + counted["rows"]:
        return df, 0
    return df.where(stretch), counted["before"]


def slice_ordered(
    df: DataFrame, order: Sequence[Order], skip: int, limit: int, shallow: int = SHALLOW_ROWS
) -> DataFrame:
    """Rows ``skip .. skip+limit`` of the ordered frame.

    A shallow page is a per-partition top-k. A deep one would hold back ``skip + limit`` rows
    in one place. There the order columns of the rows near that position are sorted, over the
    cluster, to find the page's first row; the page is a top-k over the rows from that one on.
    """
    check_page(skip, limit)
    columns = [part.column() for part in order]
    if skip + limit <= shallow:
        return df.orderBy(*columns).offset(skip).limit(limit)
    if limit > SHALLOW_ROWS:
        return _cut(df, columns, skip, limit)

    names = [part.name for part in order]
    stretch, before = _near(df.select(*names), order, skip)
    ranked = _ranked(stretch, columns)
    first = ranked.where(F.col(_RANK) == skip - before).first()
    if first is None:
        return df.limit(0)
    start = [first[name] for name in names]
    same = F.lit(True)
    for name, value in zip(names, start, strict=True):
        same = same & F.col(name).eqNullSafe(F.lit(value))
    # rows that equal the first in all order columns and sort before it
    beside = ranked.where(same & (F.col(_RANK) < skip - before)).count()
    if beside + limit > SHALLOW_ROWS:
        return _cut(df, columns, skip, limit)
    rest = df.where(after_row(order, start, inclusive=True))
    return rest.orderBy(*columns).offset(beside).limit(limit)


def page_desc(
    df: DataFrame,
    order_col: str,
    skip: int = 0,
    limit: int = 100,
    nulls: str = "last",
    tie: str | None = "id",
) -> DataFrame:
    """One page, newest first."""
    return slice_ordered(df, newest_order(order_col, tie, nulls), skip, limit)


def page_after(
    df: DataFrame, order_col: str, last_time, last_key, limit: int = 100, nulls: str = "last", tie: str = "id"
) -> DataFrame:
    """The page after the row (``last_time``, ``last_key``) of the previous one.

    Walking pages this way costs one filtered top-k each, however deep the walk.
    """
    order = newest_order(order_col, tie, nulls)
    rest = df.where(after_row(order, [last_time, last_key]))
    return rest.orderBy(*[part.column() for part in order]).limit(limit)


def page_adaptive(
    df: DataFrame,
    order_col: str = "publish_time",
    skip: int = 0,
    limit: int = 100,
    nulls: str = "last",
    tie: str | None = None,
) -> DataFrame:
    """A page sorted by ``order_col`` if the table has it, else by key so that it is repeatable."""
    key = tie or ("id" if "id" in df.columns else df.columns[0])
    if order_col in df.columns:
        return page_desc(df, order_col, skip, limit, nulls, key)
    return slice_ordered(df, [Order(key)], skip, limit)


def total_of(df: DataFrame, name: str = "total_count") -> DataFrame:
    """One row: the number of rows."""
    return df.agg(F.count(F.lit(1)).alias(name))


def page_with_total(df: DataFrame, page: DataFrame, name: str = "total_count") -> tuple[DataFrame, DataFrame]:
    """(page with the unpaged total on each row, one-row total).

    The total is a scalar subquery, not a join. It comes back on its own too, because an
    empty page has no row to carry it.
    """
    total = total_of(df, name)
    return page.withColumn(name, total.scalar()), total


def page_summary(df: DataFrame, page: int, size: int) -> DataFrame:
    """Arithmetic of the pager: total, page count, rows skipped, range shown.

    ``page`` outside 1..pages is ignored by the pager, shown as ``in_range`` false.
    """
    total = F.col("total_count")
    pages = F.greatest(F.ceil(total / F.lit(size)), F.lit(1)).cast("bigint")
    return total_of(df).select(
        total,
        F.lit(page).cast("bigint").alias("page"),
        F.lit(size).cast("bigint").alias("page_size"),
        pages.alias("pages"),
        F.lit((page - 1) * size).cast("bigint").alias("skip"),
        F.lit((page - 1) * size + 1).cast("bigint").alias("shown_from"),
        F.least(F.lit(page * size).cast("bigint"), total).alias("shown_to"),
        ((F.lit(page) >= 1) & (F.lit(page) <= pages)).alias("in_range"),
    )


def first_match(df: DataFrame, order: Sequence[str] | None = None, key: str | None = None) -> DataFrame:
    """The first row by ``order``, of the whole frame or of each ``key``."""
    if key is None:
        return df.orderBy(*order).limit(1) if order else df.limit(1)
    return first_per_key(df, key, order or [c for c in df.columns if c != key])


def first_per_key(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """The row that comes first per key, as one aggregate.

    Copies of a hot key are reduced where they lie, before the shuffle; a ranking window
    would bring all of them to one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    by = [order] if isinstance(order, str) else list(order)
    first = F.min_by(F.struct(*df.columns), F.struct(*by))
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(first.alias("__row")).select("__row.*")


def last_per_key(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """As ``first_per_key``, the row that comes last."""
    keys = [key] if isinstance(key, str) else list(key)
    by = [order] if isinstance(order, str) else list(order)
    last = F.max_by(F.struct(*df.columns), F.struct(*by))
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(last.alias("__row")).select("__row.*")


def lookup(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Each asked key with its row; the other columns are NULL where there is none."""
    return lookup_join(keys.select(key), df, key, "left")


def exactly_one(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Each asked key with its number of rows, a status and, for exactly one, that row.

    Status is ``ok``, ``missing`` or ``multiple``.
    """
    asked = keys.select(key).distinct()
    held = df
    if fits_broadcast(asked):
        held = df.join(F.broadcast(asked), key, "left_semi")
    others = [c for c in df.columns if c != key]
    found = held.groupBy(key).agg(
        F.count(F.lit(1)).alias("matches"),
        # the least value of one row is its value; columns of fixed width make a hash aggregate
        *[F.min(F.col(f"`{c}`")).alias(f"__v{i}") for i, c in enumerate(others)],
    )
    n = F.coalesce("matches", F.lit(0))
    return (
        asked.join(found, key, "left")
        .withColumn("status", F.when(n == 0, F.lit("missing")).when(n == 1, F.lit("ok")).otherwise(F.lit("multiple")))
        .select(
            key,
            n.alias("matches"),
            "status",
            *[F.when(F.col("status") == "ok", F.col(f"__v{i}")).alias(c) for i, c in enumerate(others)],
        )
    )
