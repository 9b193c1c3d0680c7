"""Row filters and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsrate.functions.binding import bind, let
from newsrate.functions.rating import label_index
from newsrate.functions.text import NO_RESULT_PHRASE, keyword_match, split_fields, trunc_int
from newsrate.lexicon import FILTER_TERMS
from newsrate.schemas import LABELS


def keyword_filter(
    df: DataFrame, col: str, terms=FILTER_TERMS, mode: str = "intended"
) -> DataFrame:
    return df.filter(keyword_match(F.col(col), terms, mode))


def ok_pages(pages: DataFrame, status_col: str = "status") -> DataFrame:
    return pages.filter(F.col(status_col) == 200)


def until_empty_page(
    pages: DataFrame, size: Column, page_col: str = "page", max_pages: int | None = None
) -> DataFrame:
    """Pages before the first one without items (``size`` 0), below ``max_pages`` if given. A
    page that cannot be read (``size`` NULL) ends nothing."""
    page = F.col(page_col)
    empty = pages.filter(size == 0).agg(F.min(page)).scalar()
    found = pages.filter(F.coalesce(page < empty, F.lit(True)))
    return found if max_pages is None else found.filter(page < max_pages)


def with_pair(df: DataFrame, mode: str = "intended", col: str = "tp") -> DataFrame:
    """Rows with a pair; in ``compat`` a blank counts as one."""
    return df.filter(F.col(col).isNotNull()) if mode == "compat" else tradable(df, col)


def tradable(df: DataFrame, col: str = "tp") -> DataFrame:
    return df.filter(F.col(col) != "")


def alerts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.filter(F.col(label_col) != 0)


def require_id(df: DataFrame, id_col: str = "tweet_id") -> DataFrame:
    return df.filter(F.col(id_col) != "")


def author_range(
    df: DataFrame,
    author: str,
    since=None,
    until=None,
    author_col: str = "author",
    repost_col: str = "is_repost",
    date_col: str = "date",
) -> DataFrame:
    """Own posts of one author with ``since <= date < until``. As in the search it stands
    for, the dates apply only when ``since`` is given."""
    out = df.filter((F.col(author_col) == author) & ~F.col(repost_col))
    if since is None:
        return out
    return out.filter((F.col(date_col) >= F.lit(since)) & (F.col(date_col) < F.lit(until)))


def drop_no_result(df: DataFrame, col: str, phrase: str = NO_RESULT_PHRASE) -> DataFrame:
    return df.filter(~F.coalesce(F.contains(F.col(col), F.lit(phrase)), F.lit(False)))


def fields_status(
    fields: Column, width: int, ints=(), rate_at: int | None = None, labels=LABELS
) -> Column:
    """``ok`` or the first fault of a split line: width, int, rate or label."""
    status = F.when(F.size(fields) != width, "width")
    for i in ints:
        status = status.when(F.get(fields, F.lit(i)).try_cast("int").isNull(), "int")
    if rate_at is not None:
        rate = trunc_int(F.get(fields, F.lit(rate_at)))
        status = status.when(rate.isNull(), "rate")
        status = status.when(label_index(rate, labels).isNull(), "label")
    return F.when(fields.isNull(), "width").otherwise(status.otherwise("ok"))


def check_rows(
    df: DataFrame,
    width: int = 8,
    ints=(),
    rate_at: int | None = None,
    labels=LABELS,
    col: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines by shape: field count, whole numbers, rating in the list. The bad
    ones carry their ``status``; one bad row never stops the others."""
    fields = split_fields(F.col(col), strip=True)
    status = let(fields, lambda f: fields_status(f, width, ints, rate_at, labels))
    checked = bind(df, status=status)
    return checked.filter("status = 'ok'").drop("status"), checked.filter("status <> 'ok'")
