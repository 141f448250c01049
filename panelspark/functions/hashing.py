"""Row hashes and order-independent table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TOKEN = "\x00"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def content_sha(*cols: Column) -> Column:
    """sha256 of the columns joined by ``|``; NULL has its own token so it never equals ''."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(NULL_TOKEN)) for c in cols]), 256)


def canonical_number(x: Column) -> Column:
    """25.0 and 25 share one text form; NULL is ''."""
    d = x.cast("double")
    return (
        F.when(x.isNull() | F.isnan(d), "")
        .when(d == F.floor(d), F.floor(d).cast("string"))
        .otherwise(d.cast("string"))
    )


def short_sha1(*texts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(t, F.lit("")) for t in texts]).cast("binary")), 1, 12)


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-independent fingerprint of a multiset of rows, in one partial aggregation.

    Each row contributes its sha256; four 8-hex-digit slices are summed as decimals wide enough for any
    row count. Sums commute, so no sort, no collected list and no hot bucket whatever the row order or
    partitioning.
    """
    names = sorted(columns or df.columns)
    texts = []
    for name in names:
        field = df.schema[name].dataType
        col = F.col(f"`{name}`")
        texts.append(F.coalesce(col.cast("string") if not isinstance(field, _INTEGRAL) else col.cast("bigint").cast("string"), F.lit(NULL_TOKEN)))
    digest = F.sha2(F.concat_ws("|", *texts), 256)
    piece = [F.conv(F.substring(F.col("_sha"), 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    return (
        df.select(digest.alias("_sha"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.coalesce(F.sum(p.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i, p in enumerate(piece)],
        )
        .select(
            "n_rows",
            F.sha2(F.concat_ws("|", "n_rows", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"),
        )
    )
