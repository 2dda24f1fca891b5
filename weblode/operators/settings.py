"""Runtime settings: stored overrides over defaults, clamped and masked.

Settings live in a table of ``key, value`` with JSON text values, optionally per ``owner``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.functions.text import strip
from weblode.lookups import KEEP_WHEN_BLANK, MASKED_KEY, SETTING_BOUNDS, SETTING_DEFAULTS


def clamp(value: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def clamp_setting(key: str, value: Column, max_crawl_depth: Column | None = None) -> Column:
    """A numeric setting within its bounds; the default depth is bounded by the current maximum depth."""
    if key == "default_crawl_depth":
        limit = max_crawl_depth if max_crawl_depth is not None else F.lit(SETTING_DEFAULTS["max_crawl_depth"])
        # Below 1 becomes 1 first, then the maximum applies.
        return F.least(limit, F.greatest(F.lit(1), value))
    if key in SETTING_BOUNDS:
        return clamp(value, *SETTING_BOUNDS[key])
    return value


def clean_text_setting(key: str, value: Column) -> Column:
    text = strip(value)
    if key == "stirling_pdf_url":
        return F.rtrim(text, F.lit("/"))
    if key == "mongodb_database":
        return F.when(text == "", F.lit(SETTING_DEFAULTS[key])).otherwise(text)
    return text


def decode(value: Column) -> Column:
    """JSON text to a typed value; text that is not JSON stands for itself."""
    return F.coalesce(F.try_parse_json(value), F.try_parse_json(_as_json_string(value)))


def _as_json_string(text: Column) -> Column:
    in_list = F.to_json(F.array(text))
    return F.substr(in_list, F.lit(2), F.length(in_list) - 2)


def encode(value) -> str:
    """A setting value as stored."""
    return json.dumps(value)


def defaults(spark: SparkSession) -> DataFrame:
    """The 13 defaults as a ``key, value`` table."""
    return spark.createDataFrame([(k, encode(v)) for k, v in SETTING_DEFAULTS.items()], "key string, value string")


def effective(defaults_table: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults with stored overrides; stored keys without a default do not survive."""
    mine = stored.select("key", F.col("value").alias("_stored"))
    return defaults_table.join(mine, "key", "left").select("key", F.coalesce("_stored", "value").alias("value"))


def effective_by_owner(stored: DataFrame, owner: str) -> DataFrame:
    """One row per owner with every setting as a JSON-text column: override, else default.

    The fixed key set is a pivot with known values, so overrides are folded map-side and the defaults
    need no join.
    """
    columns = [
        F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(encode(default))).alias(key)
        for key, default in SETTING_DEFAULTS.items()
    ]
    return stored.groupBy(owner).agg(*columns)


def masked(settings: DataFrame) -> DataFrame:
    """Settings as shown to clients: a set API key is hidden."""
    secret = (F.col("key") == "ai_api_key") & ~F.col("value").isin('""', "", "null")
    return settings.withColumn("value", F.when(secret, F.lit(encode(MASKED_KEY))).otherwise(F.col("value")))


def accepted_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that take effect.

    Dropped are nulls, unknown keys, blanks that would wipe a set value of five text settings, and
    the masked key coming back.  ``updates`` and ``current`` are ``key, value`` in JSON text.
    """
    joined = updates.join(current.select("key", F.col("value").alias("_current")), "key", "inner")
    wipes = (
        F.col("key").isin(KEEP_WHEN_BLANK) & (F.col("value") == '""') & ~F.col("_current").isin('""', "null")
    )
    echo = (F.col("key") == "ai_api_key") & (F.col("value") == encode(MASKED_KEY))
    usable = F.col("value").isNotNull() & (F.col("value") != "null")
    return joined.filter(usable & ~wipes & ~echo).select("key", "value")


def apply_updates(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Current settings with the accepted updates, clamped and cleaned.

    The default depth is clamped against the maximum depth before this update.
    """
    limit = (
        current.filter(F.col("key") == "max_crawl_depth").agg(F.max(F.col("value").cast("double"))).scalar()
    )
    number = F.col("value").try_cast("double")
    text = F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")
    value = F.col("value")
    clean = F.when(F.lit(False), value)
    for key, default in SETTING_DEFAULTS.items():
        mine = F.col("key") == key
        if isinstance(default, str):
            clean = clean.when(mine, _as_json_string(clean_text_setting(key, text)))
        else:
            kept = clamp_setting(key, number, limit)
            shown = kept.cast("string") if isinstance(default, float) else kept.cast("bigint").cast("string")
            clean = clean.when(mine, shown)
    fresh = accepted_updates(current, updates).select("key", clean.otherwise(value).alias("_new"))
    return current.join(fresh, "key", "left").select("key", F.coalesce("_new", "value").alias("value"))


def set_setting(stored: DataFrame, key: str, value) -> DataFrame:
    """Insert or replace one stored setting."""
    row = stored.sparkSession.createDataFrame([(key, encode(value))], "key string, value string")
    return stored.select("key", "value").filter(F.col("key") != key).unionByName(row)


def delete_setting(stored: DataFrame, key: str) -> DataFrame:
    return stored.filter(F.col("key") != key)
