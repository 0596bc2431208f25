"""URL canonicalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketlens.functions.text import bind, clean_text

# Query parameters dropped besides those starting with utm_.
TRACKING_PARAMETERS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]

# Ports left out of a URL, by scheme.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Scheme, authority with its slashes, path; for schemes in which slashes are not optional.
_OTHER = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)"
_PATH_SAFE = r"[^\x21\x24-\x3b\x3d\x40-\x5f\x61-\x7a\x7c\x7e]"


def _encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(
                ch.rlike(_PATH_SAFE),
                F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1"),
            ).otherwise(ch),
        ),
        "",
    )
    return F.when(path.rlike(_PATH_SAFE), encoded).otherwise(path)


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last_is_dot = F.element_at(segments, -1).isin(".", "..")
    rebuilt = F.concat(F.lit("/"), F.array_join(kept, "/"))
    rebuilt = F.when(last_is_dot & (F.size(kept) > 0), F.concat(rebuilt, F.lit("/"))).otherwise(rebuilt)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), rebuilt).otherwise(path)


def _canonical_query(query: Column) -> Column:
    """Tracking parameters removed, the rest stably sorted by name and form-encoded."""
    decode = lambda v: F.coalesce(
        F.try_url_decode(v), F.replace(v, F.lit("+"), F.lit(" "))
    )
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p, i: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("name"),
            i.alias("at"),
            decode(F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")).alias("value"),
        ),
    )
    wanted = F.filter(
        pairs,
        lambda p: ~(
            F.lower(p["name"]).startswith("utm_") | F.lower(p["name"]).isin(TRACKING_PARAMETERS)
        ),
    )
    return F.array_join(
        F.transform(
            F.array_sort(wanted),
            lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])),
        ),
        "&",
    )


def _part(url: Column, at: int) -> Column:
    return F.regexp_extract(url, _PARTS, at)


def resolve_url(value: Column, base: Column | None = None) -> Column:
    """Absolute URL text of ``value`` against ``base``; null when there is nothing to resolve against."""
    is_absolute = lambda text: text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    if base is None:
        return bind(clean_text(value), lambda text: F.when(is_absolute(text), text))

    def resolve(b: Column) -> Column:
        text, scheme, path = b["text"], b["scheme"], b["path"]
        origin = F.concat(scheme, F.lit("://"), b["authority"])
        folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
        return (
            F.when(text == "", None)
            .when(is_absolute(text), text)
            .when(text.startswith("//"), F.concat(scheme, F.lit(":"), text))
            .when(text.startswith("/"), F.concat(origin, text))
            .when(text.startswith("?"), F.concat(origin, path, text))
            .when(text.startswith("#"), F.concat(origin, path, b["query"], text))
            .otherwise(F.concat(origin, folder, text))
        )

    return bind(
        F.struct(
            clean_text(value).alias("text"), _part(base, 1).alias("scheme"),
            _part(base, 2).alias("authority"), _part(base, 3).alias("path"), _part(base, 4).alias("query"),
        ),
        resolve,
    )


def canonical_url(value: Column, base: Column | None = None) -> Column:
    """Canonical URL: no fragment, tracking parameters, default port or trailing slash. Schemes without a host keep their path as it is."""

    def read(url: Column) -> Column:
        parts = F.struct(
            F.lower(_part(url, 1)).alias("scheme"), _part(url, 2).alias("authority"),
            _part(url, 3).alias("path"), F.substring(_part(url, 4), 2, 1 << 30).alias("query"),
            F.regexp_extract(url, _OTHER, 2).alias("slashes"), F.regexp_extract(url, _OTHER, 3).alias("rest"),
        )
        return bind(parts, lambda u: F.when(u["scheme"].isin(list(DEFAULT_PORTS)), _canonical(u)).otherwise(_canonical_other(u)))

    return bind(resolve_url(value, base), read)


def _query_text(query: Column) -> Column:
    return bind(
        F.when(query == "", "").otherwise(_canonical_query(query)), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
    )


def _without_port(authority: Column, scheme: Column) -> Column:
    ports = F.coalesce(*[F.when(scheme == name, f":({port})?$") for name, port in DEFAULT_PORTS.items()])
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ports, ""))


def _canonical(u: Column) -> Column:
    """A URL with a host of a scheme that has a default port."""
    scheme = u["scheme"]
    user = F.regexp_extract(u["authority"], "^(.*@)", 1)
    path = bind(F.when(u["path"] == "", "/").otherwise(u["path"]), _encode_path)
    path = bind(bind(path, _drop_dots), lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")))
    path = bind(path, lambda p: F.when(p == "", "/").otherwise(p))
    return bind(
        _without_port(u["authority"], scheme),
        lambda h: F.when(
            (h != "") & ~h.rlike(r"[\s<>\\^|%]"), F.concat(scheme, F.lit("://"), user, h, path, _query_text(u["query"]))
        ),
    )


def _canonical_other(u: Column) -> Column:
    """A URL of any other scheme: with an authority or a path that begins with a slash it has segments, else its path is opaque."""
    host = F.lower(F.regexp_extract(u["slashes"], r"^//(.*)$", 1))
    segments = (u["slashes"] != "") | u["rest"].startswith("/")
    path = bind(bind(u["rest"], _encode_path), lambda p: F.when(p.startswith("/"), _drop_dots(p)).otherwise(p))
    trimmed = bind(path, lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")))
    start = F.when(u["slashes"] == "", F.lit("")).otherwise(F.concat(F.lit("//"), host))
    return F.when(
        u["scheme"] != "", F.concat(u["scheme"], F.lit(":"), start, F.when(segments, trimmed).otherwise(u["rest"]), _query_text(u["query"]))
    )


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def pinned_url(value: Column, fallback_path: Column, origin: str) -> Column:
    """``value`` resolved against ``origin`` when it stays on that origin, else the fallback path there."""
    stays = lambda url: F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2))) == F.lit(origin)
    fallback = F.concat(F.lit(origin), fallback_path)
    resolved = bind(resolve_url(value, F.lit(origin + "/")), lambda url: F.when(stays(url), url))
    # Resolving is dear, and a value that is absent or blank has nothing to resolve.
    return F.coalesce(F.when(clean_text(value) != "", resolved), fallback)


def is_listing_detail(url: Column, hosts: list[str], prefixes: list[str], excluded: str) -> Column:
    """Detail-page predicate: allowed host, one of the path prefixes, and not an excluded ending."""

    def fits(b: Column) -> Column:
        under = F.lit(False)
        for prefix in prefixes:
            under = under | b["path"].startswith(prefix)
        return b["host"].isin(hosts) & under & ~b["path"].rlike(excluded)

    parts = bind(url, lambda u: F.struct(F.lower(url_host(u)).alias("host"), url_path(u).alias("path")))
    return F.coalesce(bind(parts, fits), F.lit(False))
