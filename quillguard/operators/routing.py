"""Rule-based classification of requests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.patterns import quoted
from ..functions.wire import gemini_column

#: Headers of one hop, which are not forwarded.
HOP_HEADERS = ["connection", "proxy-connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length"]
#: Path prefixes, headers, query key and model prefixes that name a provider.
ANTHROPIC_PATHS = ["/v1/messages", "/v1/complete"]
GOOGLE_HEADER, GOOGLE_QUERY, GOOGLE_MODEL = "x-goog-api-key", "key", "gemini"
ANTHROPIC_HEADER, ANTHROPIC_MODEL = "anthropic-version", "claude"


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(found, F.lit(0))["value"]


def query_value(query: Column, key: str) -> Column:
    """The first value of a plain ``key``, as written; '' without one. Any text is a query string here."""
    return F.regexp_extract(F.coalesce(query, F.lit("")), rf"(?:^|&){quoted(key)}=([^&#]*)", 1)


def provider(path: Column, headers: Column, query: Column, model: Column, autodetect: bool = True) -> Column:
    """google, anthropic or openai: by path, then by header, query key and model name."""
    out = F.when(gemini_column(path), "google").when(path.startswith(ANTHROPIC_PATHS[0]) | path.startswith(ANTHROPIC_PATHS[1]), "anthropic")
    if autodetect:
        m = F.coalesce(model, F.lit(""))
        out = out.when(_filled(header(headers, GOOGLE_HEADER)) | _filled(query_value(query, GOOGLE_QUERY)) | m.startswith(GOOGLE_MODEL), "google")
        out = out.when(_filled(header(headers, ANTHROPIC_HEADER)) | m.startswith(ANTHROPIC_MODEL), "anthropic")
    return out.otherwise("openai")


def route(provider: Column, urls: dict[str, str], override: str = "") -> Column:
    """struct<upstream, tag>: an override wins; google without a URL of its own goes to openai."""
    pick = lambda url, tag: F.struct(F.lit(url).alias("upstream"), F.lit(tag).alias("tag"))
    if override:
        return pick(override, "override")
    out = F.when(provider == "anthropic", pick(urls["anthropic"], "anthropic"))
    if urls.get("google"):
        out = out.when(provider == "google", pick(urls["google"], "google"))
    return out.otherwise(pick(urls["openai"], "openai"))


def forwarded(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*HOP_HEADERS))


def model(path: Column, body: Column) -> Column:
    """The body's ``model``, its key in any case, else the path's ``/models/<model>``; '' without."""
    keys = F.filter(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), lambda k: F.lower(k) == "model")
    exact = F.get_json_object(body, "$.model")
    other = F.try_element_at(F.from_json(body, "map<string,string>"), F.get(keys, F.lit(0)))
    named = F.coalesce(exact, F.when(F.size(keys) > 0, other), F.lit(""))
    return F.when(named != "", named).otherwise(F.coalesce(F.regexp_extract(path, r"/models/([^:/]*)", 1), F.lit("")))
