"""Queue messages: envelope decoding, field resolution, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawlake.operators.pin import pin
from drawlake.spec import clean_type, is_known_type

URI_PATTERN = r"^gs://([^/]+)/(.+)$"

# Alternative fields for the object name, first non-empty one wins.
OBJECT_FIELDS = ["gcs_object", "gcs_path", "object", "name"]


def _text(variant: Column, path: str) -> Column:
    """Non-empty text at a path, trimmed, else NULL."""
    return F.nullif(F.trim(F.try_variant_get(variant, path, "string")), F.lit(""))


def _is_object(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def _from_base64(text: Column) -> Column:
    return F.try_parse_json(F.call_function("try_to_binary", text, F.lit("base64")).cast("string"))


def decode(messages: DataFrame) -> DataFrame:
    """Add ``payload`` (VARIANT) and ``problem`` (NULL when decoded).

    Shapes in order of precedence: message.data, data (both base64 of JSON),
    then the bare payload. problem: invalid_json, not_object, empty_data or
    invalid_data.
    """
    json = F.col("_json")
    parsed = pin(messages, _json=F.try_parse_json(F.col("value").cast("string")))
    typed = pin(
        parsed,
        _object=_is_object(json),
        _wrapped=_is_object(F.try_variant_get(json, "$.message", "variant")),
        _bare=F.coalesce(
            F.try_variant_get(json, "$.lottery_type", "variant"),
            F.try_variant_get(json, "$.gcs_uri", "variant"),
            F.try_variant_get(json, "$.gcs_object", "variant"),
        ).isNotNull(),
        _message_data=_text(json, "$.message.data"),
        _own_data=_text(json, "$.data"),
    )
    opened = pin(
        typed, _data=F.when(F.col("_wrapped"), F.col("_message_data")).otherwise(F.col("_own_data"))
    )
    opened = pin(
        opened,
        _inner=_from_base64(F.col("_data")),
        _bare=F.col("_bare") & ~F.col("_wrapped") & F.col("_data").isNull(),
    )
    inner, bare = F.col("_inner"), F.col("_bare")
    problem = (
        F.when(json.isNull(), "invalid_json")
        .when(~F.col("_object"), "not_object")
        .when(bare, F.lit(None))
        .when(F.col("_data").isNull(), "empty_data")
        .when(inner.isNull(), "invalid_data")
        .when(~_is_object(inner), "not_object")
    )
    decoded = pin(opened, problem=problem, payload=F.when(bare, json).otherwise(inner))
    return decoded.drop(*[c for c in decoded.columns if c.startswith("_")])


def resolve(decoded: DataFrame, *, default_bucket: str | None = None, notify_default: bool = True) -> DataFrame:
    """Typed fields of decoded messages.

    gcs_uri comes from the uri itself, from bucket and object, or from the
    default bucket and the object; execution_id falls back to a hash of the
    payload, so a redelivered message keeps its id.
    """
    payload = F.col("payload")
    fields = pin(
        decoded,
        execution_id=F.coalesce(
            _text(payload, "$.execution_id"), F.sha2(F.to_json(payload), 256)
        ),
        lottery_type=clean_type(F.coalesce(_text(payload, "$.lottery_type"), F.lit(""))),
        draw_no=_text(payload, "$.draw_no").try_cast("bigint"),
        draw_date=_text(payload, "$.draw_date"),
        _uri=_text(payload, "$.gcs_uri"),
        _bucket=F.coalesce(_text(payload, "$.gcs_bucket"), F.lit(default_bucket)),
        _name=F.coalesce(*[_text(payload, f"$.{f}") for f in OBJECT_FIELDS]),
        _flag=F.try_variant_get(payload, "$.notify", "string"),
        _flag_type=F.schema_of_variant(F.try_variant_get(payload, "$.notify", "variant")),
    )
    flag = F.col("_flag")
    # A text flag is true unless empty; a boolean or number counts by value; a null that is there is false.
    notify = (
        F.when(F.col("_flag_type") == "VOID", F.lit(False))
        .when(flag.isNull(), F.lit(notify_default))
        .when(F.col("_flag_type") == "STRING", flag != "")
        .otherwise(~flag.isin("false", "0", "0.0"))
    )
    located = pin(
        fields,
        gcs_uri=F.coalesce("_uri", F.concat(F.lit("gs://"), "_bucket", F.lit("/"), "_name")),
        notify=notify,
    )
    uri = F.col("gcs_uri")
    resolved = pin(
        located,
        bucket=F.nullif(F.regexp_extract(uri, URI_PATTERN, 1), F.lit("")),
        object=F.nullif(F.regexp_extract(uri, URI_PATTERN, 2), F.lit("")),
    )
    return resolved.drop("payload", "value", *[c for c in resolved.columns if c.startswith("_")])


def check_messages(messages: DataFrame, *, need_uri: bool = True, **options: object) -> DataFrame:
    """Resolved messages with ``reason``: NULL for usable ones, else why they are dead letters.

    The import stage needs the location of a file, the prediction stage
    (``need_uri=False``) only the pool.
    """
    resolved = resolve(decode(messages), **options)
    need = F.lit(need_uri)
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~is_known_type("lottery_type"), "unsupported_type")
        .when(need & F.col("gcs_uri").isNull(), "missing_uri")
        .when(need & (F.col("bucket").isNull() | F.col("object").isNull()), "invalid_uri")
    )
    return pin(resolved, reason=reason).drop("problem")


def split_messages(
    messages: DataFrame, *, need_uri: bool = True, **options: object
) -> tuple[DataFrame, DataFrame]:
    """(usable messages, dead letters with a reason)."""
    checked = check_messages(messages, need_uri=need_uri, **options)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(
        F.col("reason").isNotNull()
    )


def encode(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows as UTF-8 JSON message values."""
    return rows.select(F.to_json(F.struct(*fields)).cast("binary").alias("value"))
