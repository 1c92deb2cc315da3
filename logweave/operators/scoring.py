"""Pluggable scorer with rule fallback (X-01, F-11, A-36).

The rule analysis comes first, as column expressions (always there, JVM-side).
A scorer is given whole Arrow batches as pandas frames (``score_in_batches``)
and returns one reply text for each row, or None where it has none; a batch for
which it raises has no replies. Replies are repaired by column expressions over
the parsed JSON (``repair_replies``), and an event without a usable reply keeps
its rule analysis. ``analysis_method`` tells which one was used (A-36 counts
it). ``score_events_with`` wraps a scorer that takes one event. The work stays
partitioned: no group, no driver round trip.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave import rules as R
from logweave.functions import severity as sev
from logweave.functions.parse import strip

# FIXED VALUES: reply repair defaults
WRAPPER_KEY = "security_log_event"
DEFAULT_SEVERITY_MISSING = 1
DEFAULT_SEVERITY_INVALID = 5
DEFAULT_EXPLANATION = "No explanation provided"
DEFAULT_RECOMMENDATIONS_MISSING = ["Review manually"]
DEFAULT_RECOMMENDATIONS_INVALID = ["Review this event manually", "Monitor for similar events"]
SECOND_RECOMMENDATION = "Monitor for similar events"


def prompt_text(ts: Column, source: Column, category: Column, message: Column) -> Column:
    """F-10: the prompt of an event for an external scorer; the time in ISO
    form with microseconds where there are any."""
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(ts, "SSSSSS") != "000000", F.date_format(ts, ".SSSSSS")).otherwise(""))
    details = F.concat(F.lit("- Timestamp: "), iso, F.lit("\n- Source: "), source, F.lit("\n- Category: "), category, F.lit("\n- Message: "), message)
    return F.concat(F.lit(R.PROMPT_HEAD), details, F.lit(R.PROMPT_TAIL))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_int(kind: Column) -> Column:
    return kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$")


def repair_replies(reply: Column, category: Column) -> Column:
    """F-11: (severity_score, explanation, recommendations) from the JSON text
    of a reply, null where it is no JSON object. A reply wrapped under the known
    key, or an object that is the only value, is unwrapped one level; fields
    that are missing or of another type or range get their defaults."""
    whole = F.try_parse_json(reply)
    values = F.from_json(reply, "map<string,variant>")
    only = F.get(F.map_values(values), 0)
    known = F.array_contains(F.map_keys(values), WRAPPER_KEY)
    single = (F.size(F.map_keys(values)) == 1) & _kind(only).startswith("OBJECT")
    inner = F.when(known, F.try_variant_get(whole, f"$.{WRAPPER_KEY}", "variant")).when(single, only).otherwise(whole)

    def part(name: str) -> Column:
        return F.try_variant_get(inner, f"$.{name}", "variant")
    number, text, items = part("severity_score"), part("explanation"), part("recommendations")
    value = F.try_variant_get(inner, "$.severity_score", "bigint")
    severity = (F.when(number.isNull(), DEFAULT_SEVERITY_MISSING)
                .when(_is_int(_kind(number)) & value.between(1, 10), value).otherwise(DEFAULT_SEVERITY_INVALID))
    said = F.try_variant_get(inner, "$.explanation", "string")
    explanation = (F.when(text.isNull(), F.lit(DEFAULT_EXPLANATION))
                   .when((_kind(text) == "STRING") & (F.length(strip(said)) >= 10), strip(said))
                   .otherwise(F.concat(F.lit("AI analysis completed for "), category, F.lit(" event"))))
    given = F.try_variant_get(inner, "$.recommendations", "array<string>")
    some = _kind(items).startswith("ARRAY") & (F.size(given) > 0)
    second = F.array(F.lit(SECOND_RECOMMENDATION))
    listed = (F.when(items.isNull(), F.concat(F.array(*map(F.lit, DEFAULT_RECOMMENDATIONS_MISSING)), second))
              .when(some & (F.size(given) == 1), F.concat(given, second)).when(some, given)
              .otherwise(F.array(*map(F.lit, DEFAULT_RECOMMENDATIONS_INVALID))))
    fixed = F.struct(severity.cast("int").alias("severity_score"), explanation.alias("explanation"),
                     F.filter(listed, lambda x: strip(x) != "").alias("recommendations"))
    return F.when(_kind(whole).startswith("OBJECT") & _kind(inner).startswith("OBJECT"), fixed)


def score_in_batches(events: DataFrame, scorer: Callable[[pd.DataFrame], Iterable[str | None]],
                     fields: tuple[str, ...] = ("id", "timestamp", "source", "message", "category")) -> DataFrame:
    """Rule analysis for every event; the scorer's where its reply is usable.
    ``scorer`` gets ``fields`` of a batch and returns its replies in order."""
    ruled = sev.score(events)
    names = ruled.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                found = pd.Series(list(scorer(batch.select(list(fields)).to_pandas())), dtype=object)
                replies = pa.array(found, pa.string(), from_pandas=True)
                if len(replies) != batch.num_rows:
                    raise ValueError("a reply for each row")
            except Exception:  # noqa: BLE001 - a scorer that fails leaves the batch to the rules
                replies = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, replies], names=[*names, "_reply"])

    schema = T.StructType([*ruled.schema.fields, T.StructField("_reply", T.StringType())])
    fixed = ruled.mapInArrow(run, schema).withColumn("_fixed", repair_replies(F.col("_reply"), F.col("category")))
    own = ("severity_score", "explanation", "recommendations")
    return fixed.select(
        *[F.coalesce(F.col("_fixed")[c], F.col(c)).alias(c) if c in own else F.col(c) for c in names],
        F.when(F.col("_fixed").isNotNull(), "scorer").otherwise("rules").alias("analysis_method"))


def score_events_with(events: DataFrame, scorer: Callable[[dict], object] | None = None,
                      fields: tuple[str, ...] = ("id", "timestamp", "source", "message", "category")) -> DataFrame:
    """The same with a scorer that takes one event (a dict) and returns a reply
    (dict or JSON text) or None; without one, the rules for all."""
    if scorer is None:
        return sev.score(events).withColumn("analysis_method", F.lit("rules"))

    def one(event: dict) -> str | None:
        try:
            reply = scorer(event)
            return reply if reply is None or isinstance(reply, str) else json.dumps(reply)
        except Exception:  # noqa: BLE001 - a failing scorer falls back to the rules for that event
            return None
    return score_in_batches(events, lambda rows: [one(e) for e in rows.to_dict("records")], fields)


def method_counts(scored: DataFrame) -> DataFrame:
    """A-36: analyses per method."""
    return scored.groupBy("analysis_method").agg(F.count(F.lit(1)).alias("n"))
