"""Tables stored by query: buckets of the query's keys, a partition for each run.

Tables with equal buckets are joined, grouped and scored where they lie, without a shuffle. Writing a
run again replaces its rows and leaves those of other runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from variegate.sources.schemas import QUERY_KEYS, RUN_KEYS

BUCKETS = 64
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def store_by_query(df: DataFrame, table: str, buckets: int = BUCKETS,
                   keys: list[str] | None = None) -> None:
    """Store rows in a table of the catalog, in ``buckets`` of the keys of their query.

    Run columns that the rows have become partitions. If the table is there, the partitions that the
    rows belong to are replaced, all of it for rows without run columns; its columns must be theirs.
    Buckets of one table and run are files of the tasks that wrote them, so the rows are first dealt
    out by the keys, as their buckets are. A query of very many answers fills one bucket.
    """
    spark, keys = df.sparkSession, keys or QUERY_KEYS
    runs = [c for c in RUN_KEYS if c in df.columns]
    rows = df.select(*[c for c in df.columns if c not in runs], *runs)
    dealt = rows.repartition(buckets, *keys)
    if not spark.catalog.tableExists(table):
        writer = dealt.write.format("parquet").option("compression", "zstd") \
            .bucketBy(buckets, *keys).sortBy(*keys)
        (writer.partitionBy(*runs) if runs else writer).saveAsTable(table)
        return
    there = spark.table(table).columns
    if sorted(there) != sorted(rows.columns):
        raise ValueError(f"the table {table} has the columns {there}, not {rows.columns}")
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")  # writers of tables know no option for it
    try:
        dealt.select(*there).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(OVERWRITE, before)


def stored(spark: SparkSession, table: str, **run: str | bool) -> DataFrame:
    """The rows of a stored table, of one run if its columns are named; only their files are read."""
    rows = spark.table(table)
    for name, value in run.items():
        rows = rows.where(rows[name] == value)
    return rows
