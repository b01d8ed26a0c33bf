"""Candles, fills and portfolios from the driver's tables, and the readers and writers of their stored forms."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CANDLE = T.StructType([T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "vol")]])
FILL = "id long, symbol string, type string, state string, filled_amount double, filled_fees double, filled_cash_amount double, source string, client_order_id string, finished_timestamp long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which driver and executors share; unset, in a folder of this process's own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or _own_dir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, qty): an event is a trade of ``event_type_(user_id % 4)``."""
    return ticks_of(table(spark, sf_dir, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    symbol = F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string"))
    return events.select(symbol.alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") + 1).alias("price"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("qty"))


def bars(trades: DataFrame, interval: str = "6 hours") -> DataFrame:
    """Tumbling bars of trades: (symbol, ts, open, high, low, close, vol, n); one partially combined aggregate."""
    kept = trades.withColumn("bar", F.window("ts", interval)["start"])
    out = kept.groupBy("symbol", "bar").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.sum("qty").cast("double").alias("vol"), F.count("*").alias("n"),
    )
    return out.select("symbol", F.col("bar").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "vol", "n")


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as order fills; ``seq`` orders them, with every key that breaks ties."""
    sell = F.col("l_returnflag") == "R"
    tax = F.when(sell, F.col("l_extendedprice") * F.col("l_tax")).otherwise(F.col("l_quantity") * F.col("l_tax"))
    kind = F.when(sell, F.when(F.col("l_linenumber") % 2 == 0, "sell-limit").otherwise("sell-stop-limit")).otherwise(F.when(F.col("l_linenumber") % 2 == 0, "buy-limit").otherwise("buy-stop-limit"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("symbol"), kind.alias("type"), F.when(F.col("l_linestatus") == "F", "filled").otherwise("partial-canceled").alias("state"),
        F.col("l_quantity").alias("amount"), tax.alias("fees"), F.col("l_extendedprice").alias("cash"), F.col("l_shipdate").cast("timestamp_ntz").alias("time"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("suppkey"),
    )


def read_candle_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candle files, one per symbol, under an explicit schema; the symbol is the file's folder name."""
    raw = spark.read.schema(CANDLE).option("header", True).option("recursiveFileLookup", True).csv(path)
    return raw.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"symbol=([^/]+)/", 1))


def write_by_symbol(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write rows in a folder per symbol; rows of a symbol go to one task first, so each folder holds one file."""
    df.repartition("symbol").write.partitionBy("symbol").option("header", True).format(fmt).mode("append").save(path)


def upsert(df: DataFrame, path: str, version: int, keys: tuple, part: str) -> None:
    """Merge rows into a store by key: of rows with the same ``keys`` the one of the highest version counts.

    A version's folder holds all rows of the parts that it touches, those of earlier versions among them, so the rest of the
    store is neither read nor written, and a version given again after a failure replaces itself. Versions count from 0.
    """
    spark, cols = df.sparkSession, [c for c in df.columns if c != part]
    df.limit(0).write.mode("ignore").partitionBy(part).parquet(f"{path}/store_version=-1")
    touched = df.select(part).distinct()
    before = _newest(_versions(spark, path, df.schema).filter(F.col("store_version") < version).join(touched, part, "left_semi"), part)
    both = before.select(*df.columns, F.lit(0).alias("newer_")).unionByName(df.withColumn("newer_", F.lit(1)))
    last = both.groupBy(*keys, *([] if part in keys else [part])).agg(F.max_by(F.struct(*cols), F.struct("newer_", *[c for c in cols if c not in keys])).alias("row_"))
    last.select(*[F.col(f"row_.{c}").alias(c) for c in cols], part).repartition(part).write.mode("overwrite").partitionBy(part).parquet(f"{path}/store_version={version}")


def _versions(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("store_version", T.LongType())])).parquet(path)


def _newest(rows: DataFrame, part: str) -> DataFrame:
    """The rows of each part's newest version; only folder names are grouped where the store's files are listed."""
    return rows.join(rows.groupBy(part).agg(F.max("store_version").alias("store_version")), [part, "store_version"])


def read_store(spark: SparkSession, path: str, schema, part: str) -> DataFrame:
    """The rows of a store of ``upsert``, one a key, under the schema they were given with."""
    return _newest(_versions(spark, path, schema), part).select(*[f.name for f in schema.fields])


def merge_statements(df: DataFrame, path: str, batch: int) -> None:
    """A stream's batch of rows (symbol, ts, ...) into a store by day: a batch given twice or a corrected bar leaves one row a bar."""
    upsert(df.withColumn("day", F.to_date("ts")), path, batch, ("symbol", "ts"), "day")


def read_statements(spark: SparkSession, path: str, schema) -> DataFrame:
    return read_store(spark, path, T.StructType([*schema.fields, T.StructField("day", T.DateType())]), "day").drop("day")


def read_fills_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILL).option("header", True).csv(path)


def read_listing_json(spark: SparkSession, path: str, quote: str = "usdt") -> DataFrame:
    """Symbols of a listing document's ``data`` array that trade in ``quote``, as BASE-USD."""
    data = spark.read.schema("status string, data array<struct<symbol:string,state:string>>").option("multiLine", True).json(path).select(F.explode("data").alias("d"))
    return data.filter(F.col("d.symbol").contains(quote)).select("d.symbol", F.upper(F.regexp_replace("d.symbol", quote, "-usd")).alias("code"), "d.state")


def last_bars(df: DataFrame, n: int) -> DataFrame:
    late = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("rn", F.row_number().over(late)).filter(F.col("rn") <= n).drop("rn")


def seed_and_replay(df: DataFrame, n: int) -> DataFrame:
    """``seed``: among a symbol's first n bars; ``replay``: after them, or all where a symbol has fewer than n."""
    by = Window.partitionBy("symbol")
    out = df.withColumns({"rn": F.row_number().over(by.orderBy("ts")), "total": F.count("*").over(by)})
    return out.select("symbol", "ts", "close", (F.col("rn") <= n).alias("seed"), ((F.col("rn") > n) | (F.col("total") < n)).alias("replay"))


def append_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both; where both have a bar the later batch counts."""
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    keep = Window.partitionBy("symbol", "ts").orderBy(F.desc("batch"))
    return both.withColumn("rn", F.row_number().over(keep)).filter("rn = 1").drop("rn", "batch")


def finished_bars(df: DataFrame, drop: int = 2) -> DataFrame:
    late = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("rn", F.row_number().over(late)).filter(F.col("rn") > drop).drop("rn")


def split_by_order(df: DataFrame, ratio: float, key: str = "symbol", order: str = "ts") -> DataFrame:
    by = Window.partitionBy(key)
    out = df.withColumns({"rn": F.row_number().over(by.orderBy(order)), "total": F.count("*").over(by)})
    return out.withColumn("part", F.when(F.col("rn") <= F.floor(F.col("total") * ratio), "train").otherwise("test")).drop("rn", "total")
