"""Scalar functions on targets: addresses, paths, query keys, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import normalize_name

_LOOPBACK = ("localhost", "127.0.0.1", "::1")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def query_keys(query: Column) -> Column:
    """Distinct, sorted names of pairs with a value."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p.rlike(r"^[^=]+=.+"))
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))))


def parse_target(target: Column) -> Column:
    """Struct host, port, scheme, path, query of a URL, [address]:port, host:port or bare host.

    Written with patterns: the JVM's own parser refuses hosts that scanners report.
    """
    t = F.coalesce(target, F.lit(""))
    web = F.contains(t, F.lit("://"))
    bracket = t.startswith("[")
    full = F.when(bracket & ~web, F.concat(F.lit("x://"), t)).otherwise(t)
    part = lambda p: F.regexp_extract(full, p, 1)
    authority = F.regexp_extract(part(r"^[^:/?#]+://([^/?#]*)"), r"([^@]*)$", 1)
    inside = F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)
    host = F.lower(F.when(authority.startswith("["), inside).otherwise(F.regexp_extract(authority, r"^([^:]*)", 1)))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1).try_cast("int")
    simple = t.rlike(r"^[^:]*:[0-9]+$")
    url = web | bracket
    return F.struct(
        F.when(url, host).when(simple, F.regexp_extract(t, r"^([^:]*)", 1)).otherwise(t).alias("host"),
        F.when(url, port).when(simple, F.regexp_extract(t, r":([0-9]+)$", 1).try_cast("int")).alias("port"),
        F.when(web, F.lower(part(r"^([^:/?#]+)://"))).otherwise(F.lit("")).alias("scheme"),
        F.when(url, part(r"^[^:/?#]+://[^/?#]*([^?#]*)")).otherwise(F.lit("")).alias("path"),
        F.when(url, part(r"^[^#?]*\?([^#]*)")).otherwise(F.lit("")).alias("query"),
    )


def with_target(rows: DataFrame, target: Column, prefix: str = "_t_") -> tuple[DataFrame, dict[str, Column]]:
    """The parts of a target as columns of their own, so that later expressions don't repeat the parsing."""
    t = parse_target(target)
    parts = ("host", "port", "scheme", "path", "query")
    return rows.withColumns({prefix + f: t[f] for f in parts}), {f: F.col(prefix + f) for f in parts}


def canonical_path(path: Column) -> Column:
    """No trailing slash but for the root, no doubled slashes, lower case."""
    p = F.coalesce(path, F.lit(""))
    cut = F.when(F.length(p) > 1, F.regexp_replace(p, r"/+$", "")).otherwise(p)
    return F.lower(F.regexp_replace(cut, r"/+", "/"))


def fingerprint_path(path: Column) -> Column:
    return F.regexp_replace(canonical_path(path), "^/$", "")


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "https", 443).when(scheme == "http", 80)


def fingerprint_port(port: Column, scheme: Column) -> Column:
    """Null for the scheme's default port."""
    return F.when(port.eqNullSafe(default_port(scheme)), F.lit(None).cast("int")).otherwise(port)


def web_target(target: Column, scheme: str = "https") -> Column:
    t = F.trim(target)
    return F.when((t == "") | F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit(f"{scheme}://"), t))


def is_loopback(target: Column) -> Column:
    return F.coalesce(F.lower(parse_target(F.trim(target))["host"]).isin(*_LOOPBACK), F.lit(False))


def _base(target: Column) -> Column:
    """scheme://authority in lower case, without default port; loopback hosts as one."""
    base = F.lower(F.regexp_extract(target, r"^([^:/?#]+://[^/?#]*)", 1))
    plain = F.regexp_replace(base, r"^(http://.*):80$|^(https://.*):443$", "$1$2")
    return F.regexp_replace(plain, r"://(localhost|127\.0\.0\.1|\[::1\])(?=:|$)", "://loopback")


def remap_origin(value: Column, scanned: Column, origin: Column) -> Column:
    """The origin's scheme and authority in place of the scanned base that the value belongs to.

    Loopback names are the same host, and a scheme's default port may be left out.
    """
    base = F.regexp_extract(web_target(origin), r"^([^:/?#]+://[^/?#]*)", 1)
    rest = F.regexp_extract(value, r"^[^:/?#]+://[^/?#]*(.*)$", 1)
    return F.when(F.contains(value, F.lit("://")) & (base != "") & (_base(value) == _base(web_target(scanned))), F.concat(base, rest)).otherwise(value)


def endpoint_segment(segment: Column) -> Column:
    """Numbers and hex ids as one placeholder."""
    ident = segment.rlike(r"^[0-9]+$") | segment.rlike(r"^[0-9a-fA-F]{8,}$") | segment.rlike(r"^[0-9a-fA-F-]{16,}$")
    return F.when(ident, "{id}").otherwise(F.lower(segment))


def endpoint_family(path: Column) -> Column:
    """The first two segments, ids replaced."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(F.slice(parts, 1, 2), endpoint_segment), "/"))


def target_identity(asset_id: Column, meta: Column | None = None, parsed: dict[str, Column] | None = None) -> dict[str, Column]:
    """Host, scheme, port, path and query keys that a finding is told by: what the asset id says comes before the metadata.

    ``parsed`` are the target's parts, where they exist already. The keys name each of these several times,
    so a caller with many rows makes columns of them first.
    """
    a = parsed or parse_target(asset_id)
    get = lambda f, kind="string": meta[f] if meta is not None else F.lit(None).cast(kind)
    web = F.contains(asset_id, F.lit("://"))
    simple = asset_id.rlike(r"^[^:\[]+:[0-9]+$") | (asset_id.startswith("[") & a["port"].isNotNull())
    own_keys = query_keys(a["query"])
    return {
        "host": F.lower(F.coalesce(F.when(web | simple, none_if_empty(a["host"])), none_if_empty(get("host")), a["host"])),
        "scheme": F.lower(F.coalesce(F.when(web, a["scheme"]), none_if_empty(get("scheme")), F.lit(""))),
        "port": F.when(web, F.coalesce(a["port"], default_port(a["scheme"]))).when(simple, a["port"]).otherwise(get("port", "int")),
        "path": fingerprint_path(F.when(web & (a["path"] != ""), a["path"]).otherwise(get("path"))),
        "keys": F.array_join(F.when(F.size(own_keys) > 0, own_keys).otherwise(F.array_sort(F.coalesce(get("query_keys", "array<string>"), F.array().cast("array<string>")))), "&"),
    }


def identity_keys(norm: Column, at: dict[str, Column], meta: Column | None = None) -> Column:
    """Struct strict, general, host_only of a normalised name and what ``target_identity`` says."""
    get = lambda f: meta[f] if meta is not None else F.lit(None).cast("string")
    host, path, port = at["host"], at["path"], fingerprint_port(at["port"], at["scheme"]).cast("string")
    join = lambda *parts: F.concat_ws("::", *[none_if_empty(p) for p in parts])
    return F.struct(
        join(norm, host, port, path, at["keys"], F.lower(get("parameter")), F.upper(get("method"))).alias("strict"),
        F.when(path != "", join(norm, host, path, port)).otherwise(join(norm, host, port)).alias("general"),
        join(norm, host).alias("host_only"),
    )


def fingerprints(name: Column, asset_id: Column, meta: Column | None = None, parsed: dict[str, Column] | None = None, norm: Column | None = None) -> Column:
    """Struct strict, general, host_only of a finding; ``parsed`` and ``norm`` are the target's parts and the normalised name, where they exist already."""
    return identity_keys(normalize_name(name) if norm is None else norm, target_identity(asset_id, meta, parsed), meta)


def target_slug(target: Column) -> Column:
    """A name for folders: host and port, other signs as underscores."""
    t = parse_target(F.trim(target))
    base = F.concat_ws("_", none_if_empty(t["host"]), t["port"].cast("string"))
    clean = F.regexp_replace(F.regexp_replace(F.lower(base), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(clean == "", "unknown").otherwise(clean)
