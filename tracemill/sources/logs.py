"""Gateway logs: lines to records, one outcome for each, weeks and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """Each line with its record as VARIANT; null where it is not a JSON object."""
    v = F.try_parse_json(line)
    return lines.withColumn("record", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v))


def string_field(name: str) -> Column:
    """A string field; null for another type."""
    v = F.try_variant_get("record", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("record", f"$.{name}", "string"))


def integer_field(name: str) -> Column:
    """A number cut towards zero; null for another type, a boolean included."""
    v = F.try_variant_get("record", f"$.{name}", "variant")
    kind = F.schema_of_variant(v)
    return F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.try_variant_get("record", f"$.{name}", "double").try_cast("bigint"))


def boolean_field(name: str) -> Column:
    v = F.try_variant_get("record", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get("record", f"$.{name}", "boolean"))


def body_field(name: str) -> Column:
    return F.nullif(string_field(name), F.lit(""))


def with_fields(lines: DataFrame) -> DataFrame:
    end = strings.completion_ms(string_field("timestamp"))
    p = parsed(lines).withColumn("end_ms", end)
    return p.select(
        "*", string_field("request_id").alias("request_id"), string_field("user_id").alias("user_id"), integer_field("status_code").alias("status_code"), integer_field("latency_ms").alias("latency_ms"),
        boolean_field("stream").alias("stream"), body_field("prompt").alias("prompt"), (F.col("end_ms") - F.coalesce(integer_field("latency_ms"), F.lit(0))).alias("start_ms"),
        strings.let(F.try_parse_json(string_field("metadata")), lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.user_agent", "variant")) == "STRING", F.try_variant_get(v, "$.user_agent", "string"))).alias("user_agent"),
    )


def harness_of(text: Column, agent: Column, phrases: list[tuple[str, str]], agents: list[tuple[str, str]]) -> Column:
    """The harness whose phrase starts earliest in the text (ties by table order), else by user agent, else other-agent."""
    at = [F.when(F.instr(text, p) > 0, F.struct(F.instr(text, p).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (p, name) in enumerate(phrases)]
    by_agent = F.lit("other-agent")
    for part, name in reversed(agents):
        by_agent = F.when(F.contains(F.lower(agent), F.lit(part)), name).otherwise(by_agent)
    first = F.array_min(F.array_compact(F.array(*at)))["name"] if at else F.lit(None).cast("string")
    return F.coalesce(first, by_agent)


def outcomes(fields: DataFrame, excluded_users: list[str], harness: Column, shortlist: list[str]) -> DataFrame:
    """Each line with the first filter it fails, or kept; cheap tests come first."""
    outcome = (
        F.when(F.col("record").isNull(), "unparsable").when(F.col("request_id").isNull() | F.col("end_ms").isNull(), "unreadable_record").when(F.col("user_id").isin(*excluded_users), "excluded_user")
        .when(~F.col("status_code").eqNullSafe(F.lit(200)), "status_not_200").when(~harness.isin(*shortlist), "harness_not_shortlisted").otherwise("kept")
    )
    return fields.withColumn("outcome", outcome)


def manifest(fields: DataFrame, week: str) -> DataFrame:
    """Lines, bytes, invalid lines, earliest and latest completion, and records of another week."""
    own = F.date_format(strings.week_of(F.to_date(F.timestamp_millis("end_ms"))), "yyyy-MM-dd")
    return fields.agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.count_if(F.col("record").isNull()).alias("invalid"), F.min("end_ms").alias("earliest"), F.max("end_ms").alias("latest"), F.count_if(own != week).alias("other_weeks"))


def by_week(fields: DataFrame) -> DataFrame:
    """Lines with their week folder; null for lines without a time."""
    sunday = strings.week_of(F.to_date(F.timestamp_millis("end_ms")))
    return fields.withColumn("week", F.when(F.col("end_ms").isNotNull(), strings.week_name(sunday)))


def split_weeks(fields: DataFrame, path: str, existing: list[str]) -> DataFrame:
    """Writes each line to its week's folder, never to one that exists; returns line counts by week and whether written."""
    w = by_week(fields)
    new = w.filter(F.col("week").isNotNull() & ~F.col("week").isin(*existing))
    new.select("week", "value").write.mode("append").partitionBy("week").text(path)
    return w.groupBy("week").agg(F.count("*").alias("lines")).withColumn("written", F.col("week").isNotNull() & ~F.col("week").isin(*existing))
