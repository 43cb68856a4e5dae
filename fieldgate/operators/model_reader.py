"""Model-backed extraction from a table of cached responses: prompts, keys, leaves with quotes. No network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DOCUMENTS, LOCATION_FIELDS, SCALARS, TEXT_FIELDS, Version
from ..functions.scalars import model_number, model_text
from ..functions.text import quote_span
from .extract import NUMBER, TEXT, make_field, missing

LEAF = "struct<value:string,quote:string,confidence:double>"
LOSS_FIELDS = ["lossDate", "cause", "paid", "reserved", "status"]
RESPONSE = "struct<" + ",".join(
    [*(f"{n}:{LEAF}" for n in SCALARS[:4]), "locations:array<struct<" + ",".join(f"{n}:{LEAF}" for n in LOCATION_FIELDS) + ">>", "losses:array<struct<" + ",".join(f"{n}:{LEAF}" for n in LOSS_FIELDS) + ">>"]
) + ">"
SYSTEM = "Read the documents and report each field as JSON with the value and an exact quote; report null for what the documents leave blank."


def prompt(version: Version) -> Column:
    """The documents in scope, in order, each under a heading with its id and file name."""
    parts = [F.when(F.col(d).isNotNull(), F.concat(F.lit(f"=== DOCUMENT {d} ({d}.txt) ===\n"), F.col(d))) for d in DOCUMENTS if d in version.profile.documents]
    return F.concat_ws("\n\n", *parts)


def request_key(version: Version) -> Column:
    request = F.struct(F.lit(version.profile.model).alias("model"), F.lit(SYSTEM).alias("system"), prompt(version).alias("user"))
    return F.sha2(F.to_json(request), 256)


def leaf_field(leaf: Column, docs: list[tuple[str, Column]], text: bool) -> Column:
    """A leaf as a field: no value is llm-miss at 0.4; a quote that no document has caps the confidence at 0.45 and leaves no evidence."""
    kind = TEXT if text else NUMBER
    value = model_text(leaf["value"]) if text else F.floor(model_number(leaf["value"]) + 0.5).cast("bigint")
    where = quote_span(docs, leaf["quote"])
    claimed = F.least(F.greatest(F.coalesce(leaf["confidence"], F.lit(0.85)), F.lit(0.0)), F.lit(1.0))
    out = F.when(value.isNull(), missing(0.4, "llm-miss", kind=kind))
    out = out.when(where.isNull(), make_field(value, F.least(claimed, F.lit(0.45)), "llm-extract", None, "the quote is in no document", kind))
    return out.otherwise(make_field(value, claimed, "llm-extract", where, kind=kind))


def extract_from_model(packets: DataFrame, version: Version, cache: DataFrame) -> DataFrame:
    """The columns of :func:`fieldgate.operators.extract.extract`, from ``cache`` (key, content, input_tokens, output_tokens, model).

    A packet without a cached response, or one that is no JSON object, raises an error when it is read.
    """
    docs = [(d, F.col(d)) for d in DOCUMENTS if d in version.profile.documents]
    rows = packets.select("packet_id", *DOCUMENTS).withColumn("key", request_key(version)).join(cache, "key", "left")
    failed = lambda why: F.raise_error(F.concat(F.lit(why), F.col("packet_id")))
    content = F.when(F.col("content").isNotNull(), F.col("content")).otherwise(failed("no cached response for packet "))
    rows = rows.withColumn("r", F.from_json(content, RESPONSE, {"mode": "FAILFAST"}))
    one = lambda n: leaf_field(F.col(f"r.{n}"), docs, n in TEXT_FIELDS)
    none_span = F.lit(None).cast("struct<doc:string,start:int,end:int>")
    located = F.transform(
        F.coalesce("r.locations", F.array()),
        lambda x, i: F.struct(i.alias("row_idx"), F.concat(F.lit("L"), (i + 1).cast("string")).alias("loc_id"), none_span.alias("source_span"), *(leaf_field(x[n], docs, n in TEXT_FIELDS).alias(n) for n in LOCATION_FIELDS)),
    )
    lost = F.transform(
        F.coalesce("r.losses", F.array()),
        lambda x, i: F.struct(F.concat(F.lit("llm-claim-"), (i + 1).cast("string")).alias("loss_id"), none_span.alias("source_span"), *(leaf_field(x[n], docs, n not in ("paid", "reserved")).alias(n) for n in LOSS_FIELDS)),
    )
    rows = rows.withColumns({n: one(n) for n in SCALARS[:4]} | {"locations": located, "losses": lost})
    amount = lambda name: F.aggregate(F.transform("losses", lambda x: F.coalesce(x[name]["value"], F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    unread = F.size(F.filter("losses", lambda x: x["paid"]["value"].isNull())) + F.size(F.filter("losses", lambda x: x["reserved"]["value"].isNull()))
    some = F.size("losses") > 0
    incurred = make_field(amount("paid") + amount("reserved"), F.when(unread == 0, 0.95).otherwise(0.6), "sum:claim-rows", kind=NUMBER)
    return rows.select(
        "packet_id",
        F.lit(version.id).alias("version_id"),
        *SCALARS[:4],
        F.when(some, incurred).otherwise(missing(0.2, "no-loss-rows", kind=NUMBER)).alias("lossRunTotalIncurred"),
        make_field(F.size("losses").cast("bigint"), F.when(some, 0.97).otherwise(0.4), "count:claim-rows", kind=NUMBER).alias("lossCount"),
        "locations",
        "losses",
        F.array().cast("array<struct<seq:int,amendment_id:string,amendment_date:string,loc_hint_id:string,loc_hint_address:string,target_field:string,from_value:bigint,to_value:bigint,span:struct<doc:string,start:int,end:int>>>").alias("amendments"),
        F.array_compact(F.array(*(F.when(t.isNotNull(), F.lit(d)) for d, t in docs))).alias("documents_read"),
        sum((F.coalesce(F.length(t), F.lit(0)) for _, t in docs), F.lit(0)).cast("bigint").alias("input_chars"),
        F.lit(version.profile.passes).alias("passes"),
        F.array().cast("array<string>").alias("notes"),
    )
