"""SQL tables over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsrate.schemas import NEWS_COLUMNS

# Fixed value: rows per fetch.
FETCH_ROWS = 1000


def jdbc_options(
    url: str, table: str, bounds: tuple[int, int], n: int, properties: dict | None = None
) -> dict[str, str]:
    """Reader options: ``n`` id ranges, one connection each, bounded fetches. Credentials come
    in ``properties`` and are not kept."""
    lower, upper = bounds
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "id",
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(n),
        "fetchsize": str(FETCH_ROWS),
        **(properties or {}),
    }


def news_columns(df: DataFrame) -> DataFrame:
    """The eight news columns; the scan reads no others."""
    return df.select(*NEWS_COLUMNS)


def read_news_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    bounds: tuple[int, int],
    n: int,
    properties: dict | None = None,
) -> DataFrame:
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, bounds, n, properties))
    return news_columns(reader.load())
