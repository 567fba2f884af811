"""Data contracts: a list of named rules turned into a valid flag and an error list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import constants as C


@dataclass(frozen=True)
class Check:
    """`broken` is true where the field violates the rule; null counts as not broken."""

    field: str
    message: str
    broken: str

    def error(self) -> Column:
        return F.when(F.expr(self.broken), F.lit(f"{self.field}: {self.message}"))


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{name}'" for name in names)


AUTH_EVENT = [
    *[Check(f, "required", f"{f} is null")
      for f in ("transaction_id", "account_id", "card_id", "customer_id", "merchant_id")],
    Check("auth_type", "not allowed", f"auth_type is null or auth_type not in ({_listed(C.AUTH_TYPES)})"),
    Check("channel", "not allowed", f"channel is null or channel not in ({_listed(C.CHANNELS)})"),
    Check("entry_mode", "not allowed", f"entry_mode not in ({_listed(C.ENTRY_MODES)})"),
    Check("auth_amount", "must be positive", "auth_amount is null or auth_amount <= 0"),
    Check("currency_code", "must have 3 characters", "currency_code is null or length(currency_code) <> 3"),
    Check("merchant_country_code", "must have 2 characters",
          "merchant_country_code is null or length(merchant_country_code) <> 2"),
]
FEATURE_VECTOR = [
    *[Check(f, "must be at least 0", f"{f} < 0") for f in C.FEATURES if f != "proxy_vpn_tor_flag"],
    *[Check(f, "must be at most 1", f"{f} > 1") for f in C.UNIT_RANGE_FEATURES],
]
MODEL_SCORE = [
    Check("fraud_probability", "must be in [0, 1]",
          "fraud_probability is null or fraud_probability < 0 or fraud_probability > 1"),
    Check("calibrated_probability", "must be in [0, 1]",
          "calibrated_probability is null or calibrated_probability < 0 or calibrated_probability > 1"),
    Check("risk_band", "not allowed",
          f"risk_band is null or risk_band not in ({_listed([n for _, n in C.RISK_BANDS] + [C.LOWEST_BAND])})"),
    Check("latency_ms", "must be at least 0", "latency_ms is null or latency_ms < 0"),
]


def validate(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Add `errors` (array of texts) and `valid`."""
    errors = F.split(F.concat_ws("\n", *[check.error() for check in checks]), "\n")
    return df.withColumn("errors", F.filter(errors, lambda e: e != "")).withColumn("valid", F.size("errors") == 0)


def split_valid(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the check columns, quarantined rows with their errors)."""
    checked = validate(df, checks)
    return checked.where("valid").drop("valid", "errors"), checked.where("not valid").drop("valid")


def coerce_features(df: DataFrame, source: str = "feature_json") -> DataFrame:
    """Read the 19 features from a JSON column: missing or unreadable values give 0, an absent gap stays null."""
    fields = F.from_json(F.col(source), "map<string,string>")
    parsed = df.withColumn("_fields", fields)

    def feature(name: str) -> Column:
        text = F.col("_fields")[name]
        if name == "proxy_vpn_tor_flag":
            return F.when(text.isin("true", "1"), F.lit(True)).otherwise(F.lit(False)).alias(name)
        kind = "bigint" if name in C.COUNT_FEATURES else "double"
        value = text.try_cast(kind)
        if name == "seconds_since_last_txn":
            return F.when(text.isNotNull(), F.coalesce(value, F.lit(0))).alias(name)
        return F.coalesce(value, F.lit(0).cast(kind)).alias(name)

    return parsed.select(*df.columns, *[feature(name) for name in C.FEATURES if name not in df.columns])


def table_report(df: DataFrame, expected: dict[str, str], rules: dict[str, str], report: str) -> DataFrame:
    """One row per agreed field: rows of the table, rows without a value, and rows that break the field's rule, an SQL text
    that is true where broken. A field that is missing or has another type than agreed is broken in every row."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = []
    for name, kind in expected.items():
        fits = actual.get(name) == kind
        broken = F.count_if(F.coalesce(F.expr(rules[name]), F.lit(False))) if fits and name in rules else (
            F.lit(0).cast("long") if fits else F.count("*"))
        empty = F.count_if(F.col(name).isNull()) if name in actual else F.count("*")
        fields.append(F.struct(F.lit(report).alias("report"), F.lit(name).alias("field"), F.count("*").alias("n_rows"),
                               empty.alias("n_null"), broken.alias("n_broken")).alias(f"_{len(fields)}"))
    one = df.agg(*fields)
    return one.select(F.explode(F.array(*one.columns)).alias("r")).select("r.*")
