"""Storage addresses, their expiry, and errors of storage services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes, and the shapes of storage URLs.
NATIVE = ("s3", "supabase", "server")
_HOSTED = r"(?i)^https?://[a-z0-9]+\.supabase\.co(?::\d+)?/storage/v1/object/(?:public|sign|authenticated)/([^/?#]+)/([^?#]+)"
_BUCKET_HOST = r"(?i)^https?://([a-z0-9][a-z0-9\-.]{1,61}[a-z0-9])\.s3(?:\.[a-z0-9-]+)?\.amazonaws\.com/+([^?#]+)"
_BUCKET_PATH = r"(?i)^https?://s3(?:\.[a-z0-9-]+)?\.amazonaws\.com/+([^/?#]+)/([^?#]+)"
_URI = r"(?i)^(s3|supabase|server)://([^/?#]*)/*([^?#]*)"


def parse_storage_url(c: Column) -> Column:
    """struct<scheme, storage_path, original>; null for what names no storage."""

    def two(pattern: str, scheme: str, lower_first: bool = False) -> Column:
        first = F.regexp_extract(c, pattern, 1)
        path = F.concat_ws("/", F.lower(first) if lower_first else first, F.regexp_extract(c, pattern, 2))
        return F.when(c.rlike(pattern), F.struct(F.lit(scheme).alias("scheme"), path.alias("storage_path"), c.alias("original")))

    parts = F.filter(F.array(F.regexp_extract(c, _URI, 2), F.regexp_extract(c, _URI, 3)), lambda x: x != "")
    native = F.when(c.rlike(_URI), F.struct(F.lower(F.regexp_extract(c, _URI, 1)).alias("scheme"), F.array_join(parts, "/").alias("storage_path"), c.alias("original")))
    return F.coalesce(two(_HOSTED, "supabase"), two(_BUCKET_HOST, "s3", True), two(_BUCKET_PATH, "s3"), native)


def native_uri(c: Column) -> Column:
    p = parse_storage_url(c)
    return F.concat(p["scheme"], F.lit("://"), p["storage_path"])


def is_cloud_uri(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^(s3|supabase|server)://"), F.lit(False))


def is_storage_url(c: Column) -> Column:
    return parse_storage_url(c).isNotNull()


def _query(c: Column, name: str) -> Column:
    found = F.regexp_extract(c, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", found)


def expires_at(c: Column) -> Column:
    """Seconds since 1970 when a signed URL ends: `exp` of its JWT, else its signing time and its length; else null."""
    body = F.element_at(F.split(_query(c, "token"), r"\."), 2)
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    jwt = F.get_json_object(F.decode(F.try_to_binary(padded, F.lit("base64")), "utf-8"), "$.exp").try_cast("long")
    signed = F.try_to_timestamp(_query(c, "X-Amz-Date"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(jwt, F.unix_timestamp(signed) + _query(c, "X-Amz-Expires").try_cast("long"))


def expires_in(c: Column, now: Column) -> Column:
    """Seconds left at `now` (seconds since 1970)."""
    return expires_at(c) - now


def ensure_action(c: Column, now: Column, least: int = 60) -> Column:
    """`sign` for a native address; `keep` for a URL without an end or with more than `least` seconds left; else `resign`."""
    left = expires_in(c, now)
    return F.when(is_cloud_uri(c), "sign").when(left.isNull() | (left > least), "keep").otherwise("resign")


# Parts of messages of errors that stay, and of errors that pass.
PERMANENT = ("not found", "404", "403", "401", "access denied", "forbidden", "unauthorized", "nosuchkey", "nosuchbucket", "invalid")
TRANSIENT = ("timeout", "timed out", "connection", "temporarily", "503", "502", "504", "500", "429", "throttl", "slowdown", "rate limit", "reset by peer", "broken pipe")
OS_ERRORS = ("ConnectionError", "TimeoutError", "OSError", "ConnectionResetError", "BrokenPipeError")


def is_transient(message: Column, kind: Column | None = None) -> Column:
    """Whether an error may pass: permanent parts win, then transient parts, then the kinds of system errors."""
    low = F.lower(message)
    has = lambda words: low.rlike("|".join(rf"\Q{w}\E" for w in words))
    return F.when(has(PERMANENT), False).when(has(TRANSIENT), True).otherwise(kind.isin(*OS_ERRORS) if kind is not None else F.lit(False))


def storage_uri(backend: Column, bucket: Column, user: Column, path: Column) -> Column:
    return F.concat(backend, F.lit("://"), bucket, F.lit("/"), user, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def version_uri(backend: Column, bucket: Column, prefix: Column, file_id: Column, version: Column, name: Column) -> Column:
    return F.concat(backend, F.lit("://"), F.concat_ws("/", bucket, prefix, file_id, F.concat(F.lit("v"), version), name))
