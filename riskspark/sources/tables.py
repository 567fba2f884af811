"""Typed table scans and the adapters that shape the generic test tables as payment data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A Parquet table under its declared schema; no inference pass over the files."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")


def _text(value) -> Column:
    return value.cast("string")


def auth_events(events: DataFrame) -> DataFrame:
    """Authorization events as received: billing amount, device, address and country may be missing."""
    e, user = F.col("event_id"), F.col("user_id")
    account = user * 10 + e % 3
    octet = F.floor(user / 6)
    amount = F.col("value").cast(MONEY)
    return events.select(
        e.alias("auth_event_id"),
        e.alias("transaction_id"),
        F.col("ts").alias("event_time"),
        user.alias("customer_id"),
        account.alias("account_id"),
        (account * 100 + e % 5).alias("card_id"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("merchant_id"),
        F.when(e % 11 != 0, F.concat(F.lit("dev_"), _text(F.floor(user / 4)))).alias("device_id"),
        F.when(
            e % 17 != 0,
            F.concat(F.lit("10.0."), _text(F.floor(user / 1536)), F.lit("."), _text(octet % 256)),
        ).alias("ip_address"),
        F.when(F.col("event_type") == "click", "card_present")
        .when(F.col("event_type") == "signup", "recurring")
        .otherwise("card_not_present").alias("auth_type"),
        F.element_at(F.array(*[F.lit(c) for c in ("pos", "web", "mobile", "api")]), (e % 4 + 1).cast("int"))
        .alias("channel"),
        amount.alias("auth_amount"),
        F.element_at(F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP", "CAD", "XYZ")]), (e % 5 + 1).cast("int"))
        .alias("currency_code"),
        F.when(
            e % 97 != 0,
            F.element_at(F.array(*[F.lit(c) for c in ("US", "GB", "DE")]), (e % 3 + 1).cast("int")),
        ).alias("merchant_country_code"),
        F.when(e % 13 != 0, amount).alias("billing_amount_usd"),
        "event_type",
    )


def normalized_events(raw: DataFrame) -> DataFrame:
    """Events as stored: a missing or zero billing amount is the authorization amount, the status starts pending."""
    zero = F.lit(0).cast(MONEY)
    return raw.withColumn(
        "billing_amount_usd", F.coalesce(F.nullif(F.col("billing_amount_usd"), zero), F.col("auth_amount"))
    ).withColumn("auth_status", F.lit("pending"))


def fraud_labels(events: DataFrame) -> DataFrame:
    e, ts = F.col("event_id"), F.col("ts")

    def later(days) -> Column:
        return ts + F.make_dt_interval(days.cast("int"))

    rows = F.array_compact(F.array(
        F.when(e % 10 < 8, F.struct(
            (e * 2).alias("label_id"),
            ((F.col("event_type") == "error") & (e % 4 == 0)).alias("is_fraud"),
            F.lit("confirmed_chargeback").alias("label_source"),
            later(F.lit(7) + e % 53).alias("label_received_at"))),
        F.when(e % 20 == 0, F.struct(
            (e * 2 + 1).alias("label_id"),
            (F.col("event_type") == "error").alias("is_fraud"),
            F.lit("investigator_confirmed").alias("label_source"),
            later(F.lit(60) + e % 60).alias("label_received_at"))),
    ))
    return events.select(e.alias("auth_event_id"), F.explode(rows).alias("r")).select(
        "r.label_id", "auth_event_id", "r.is_fraud", "r.label_source", "r.label_received_at")


def chargebacks(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.where((F.col("event_type") == "error") & (e % 8 == 0)).select(
        e.alias("chargeback_id"), e.alias("auth_event_id"), F.col("value").cast(MONEY).alias("chargeback_amount"),
        (F.col("ts") + F.make_dt_interval((F.lit(1) + e % 10).cast("int"))).alias("chargeback_received_at"))


def dim_customer(customer: DataFrame) -> DataFrame:
    nation = F.col("c_nationkey")
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.element_at(F.array(*[F.lit(c) for c in ("US", "GB", "DE", "FR", "ZZ")]), nation % 5 + 1)
        .alias("home_country_code"),
        F.when(nation % 3 == 0, "NYC").when(nation % 3 == 1, "london").alias("home_region"))


def dim_device(events: DataFrame) -> DataFrame:
    g = F.col("g")
    return events.select(F.floor(F.col("user_id") / 4).alias("g")).distinct().where(g % 9 != 1).select(
        F.concat(F.lit("dev_"), _text(g)).alias("device_id"), (g % 5 == 0).alias("emulator_flag"),
        (g % 7 == 0).alias("rooted_jailbroken_flag"))


def dim_ip(events: DataFrame) -> DataFrame:
    g = F.col("g")
    return events.select(F.floor(F.col("user_id") / 6).alias("g")).distinct().where(g % 10 != 9).select(
        F.concat(F.lit("10.0."), _text(F.floor(g / 256)), F.lit("."), _text(g % 256)).alias("ip_address"),
        F.element_at(F.array(*[F.lit(c) for c in ("US", "GB", "FR", "JP")]), (g % 4 + 1).cast("int"))
        .alias("geo_country_code"),
        F.when(g % 4 == 0, "LA").when(g % 4 == 1, "London").when(g % 4 == 2, "paris ").alias("geo_city"),
        (g % 8 == 3).alias("proxy_vpn_tor_flag"))


def dim_merchant(events: DataFrame) -> DataFrame:
    m = F.col("merchant_id")
    return events.select(F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("merchant_id")).distinct().where(
        m % 25 != 0
    ).select(m, F.element_at(F.array(*[F.lit(c) for c in ("5411", "5541", "6051", "7995")]), (m % 4 + 1).cast("int"))
             .alias("mcc"))


def scored_lines(lineitem: DataFrame, multiplier: int = 31) -> DataFrame:
    """A large scored set for threshold sweeps and evaluation; a second multiplier stands for a second model."""
    order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    return lineitem.select(
        (order * 1000000000 + part * 10000 + F.col("l_suppkey") * 10 + line).alias("auth_event_id"),
        (((order * multiplier + part * 17 + line * 7) % 1000).cast("double") / 1000).alias("probability"),
        F.col("l_extendedprice").cast(MONEY).alias("amount_usd"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("is_fraud"),
        F.col("l_linestatus").alias("segment"))


def case_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        F.col("vec_id").alias("case_id"), F.col("embedding").alias("vector"), F.col("label").alias("category"))


def agent_traces(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("step_index"), F.col("role").alias("step_type"),
        F.col("text").alias("output"))


def ops_metrics(events: DataFrame) -> DataFrame:
    """Service requests: one endpoint call per event with its status and latency."""
    e = F.col("event_id")
    return events.select(
        F.col("event_type").alias("endpoint"),
        F.when(e % 20 == 0, 500).when(e % 20 == 1, 404).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"), F.col("ts").alias("event_time"), e.alias("request_id"))
