"""Sites: canonical addresses of what is crawled, keys of their profiles, links within a site."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.functions.url import default_port, none_if_empty

#: Words of a path that say most about a site.
PREFERRED_WORDS = ("about", "service", "product", "solution", "platform", "company", "what-we-do", "mission")
_PLAIN = "^[\\x00-\\x7F]*$"


def _punycode(hosts: Column) -> Column:
    """Hosts in ASCII, label by label; null where one cannot be written so. A null host stays null."""

    def run(hosts: pd.Series) -> pd.Series:
        made: dict[str, str | None] = {}
        for host in hosts.dropna().unique():
            try:
                made[host] = host.encode("idna").decode("ascii")
            except UnicodeError:
                made[host] = None
        return pd.Series([made.get(h) if h is not None else None for h in hosts], dtype=object)

    return F.pandas_udf(run, T.StringType())(hosts)


def _joined(current: Column, href: Column) -> Column:
    """References resolved against the address of the page that they stand on; null where they can't be."""

    def run(current: pd.Series, href: pd.Series) -> pd.Series:
        def one(base: str | None, ref: str | None) -> str | None:
            try:
                return None if base is None or ref is None else urljoin(base, ref)
            except ValueError:
                return None

        return pd.Series([one(b, r) for b, r in zip(current, href, strict=True)], dtype=object)

    return F.pandas_udf(run, T.StringType())(current, href)


_PARTS = ("scheme", "authority", "place", "host", "port", "path")


def _parts(url: Column) -> dict[str, Column]:
    """scheme, authority, host, port text and path of an address with ``://``."""
    part = lambda p, i=1: F.regexp_extract(url, p, i)
    authority = part(r"^[^:/?#]+://([^/?#]*)")
    place = F.regexp_extract(authority, r"([^@]*)$", 1)
    bracket = place.startswith("[")
    host = F.when(bracket, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1))
    port = F.when(bracket, F.regexp_extract(place, r"^\[[^\]]*\]:?(.*)$", 1)).otherwise(F.regexp_extract(place, r"^[^:]*:(.*)$", 1))
    return {"scheme": F.lower(part(r"^([^:/?#]+)://")), "authority": authority, "place": place, "host": F.lower(host), "port": port, "path": part(r"^[^:/?#]+://[^/?#]*([^?#]*)")}


def _full(target: Column) -> Column:
    value = F.trim(F.coalesce(target, F.lit("")))
    return F.when(F.contains(value, F.lit("://")), value).otherwise(F.concat(F.lit("https://"), value))


def _ascii_name(host: Column) -> Column:
    plain = host.rlike(_PLAIN)
    return F.regexp_replace(F.when(plain, host).otherwise(_punycode(F.when(~plain, host))), r"\.$", "")


def _checked(p: dict[str, Column], name: Column) -> dict[str, Column]:
    """The canonical address of parsed parts and its host's name in ASCII, and why there is none."""
    labels = F.forall(F.split(name, r"\."), lambda x: (F.length(x) >= 1) & (F.length(x) <= 63))
    port = p["port"].try_cast("int")
    bad_port = (p["port"] != "") & ~F.coalesce(p["port"].rlike("^[0-9]+$") & (port <= 65535), F.lit(False))
    named = F.when(p["place"].startswith("["), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
    place = F.when((p["port"] == "") | port.eqNullSafe(default_port(p["scheme"])), named).otherwise(F.concat(named, F.lit(":"), port.cast("string")))
    error = (
        F.when((p["host"] == "") & (p["path"] == "") & (p["authority"] == ""), "empty").when(~p["scheme"].isin("http", "https"), "scheme").when(p["host"] == "", "host")
        .when(F.contains(p["authority"], F.lit("@")) & ~p["authority"].rlike("^:?@"), "credentials").when(bad_port, "port").when(~F.coalesce(labels, F.lit(False)), "host")
    )
    return {"error": error, "url": F.concat(p["scheme"], F.lit("://"), place, F.coalesce(none_if_empty(p["path"]), F.lit("/")))}


def with_site(rows: DataFrame, target: Column, url: str = "site_url", key: str = "site", error: str = "site_error") -> DataFrame:
    """``rows`` with the canonical http(s) address of a target, the key of its site, and why it has none.

    The scheme is https if there is none; names are in ASCII; a default port, credentials, query and
    fragment are never part of it. Errors: empty, scheme, host, credentials, port. Each step is a column
    of its own, so that no later one repeats the parsing.
    """
    staged = rows.withColumn("_w_full", _full(target))
    staged = staged.withColumns({f"_w_{k}": v for k, v in _parts(F.col("_w_full")).items()})
    p = {k: F.col(f"_w_{k}") for k in _PARTS}
    staged = staged.withColumn("_w_name", _ascii_name(p["host"]))
    staged = staged.withColumns({f"_w_{k}": v for k, v in _checked(p, F.col("_w_name")).items()})
    staged = staged.withColumns({url: F.when(F.col("_w_error").isNull(), F.col("_w_url")), error: F.col("_w_error")})
    return staged.withColumn(key, site_key(F.col(url))).select(*[c for c in rows.columns if c not in (url, key, error)], url, key, error)


def site_key(url: Column) -> Column:
    """Key of a site: a readable name and a hash of host and port, for an address that ``with_site`` gave."""
    p = _parts(url)
    who = F.when((p["port"] == "") | p["port"].try_cast("int").eqNullSafe(default_port(p["scheme"])), p["host"]).otherwise(F.concat_ws(":", p["host"], p["port"]))
    slug = F.regexp_replace(F.regexp_replace(F.lower(who), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(url.isNotNull(), F.concat(F.coalesce(none_if_empty(F.substring(slug, 1, 80)), F.lit("site")), F.lit("--"), F.substring(F.sha2(who, 256), 1, 12)))


def _scope(url: Column) -> Column:
    p = _parts(url)
    port = p["port"].try_cast("int")
    return F.struct(p["host"].alias("host"), F.when(~port.eqNullSafe(default_port(p["scheme"])), port).alias("port"))


def site_link(seed: Column, current: Column, href: Column) -> Column:
    """The address that a reference on the page ``current`` leads to, if it is within the site of ``seed``; else null.

    Host and port must be the seed's; query and fragment are left out.
    """
    to = _joined(current, href)
    p = _parts(to)
    inside = p["scheme"].isin("http", "https") & ~(F.contains(p["authority"], F.lit("@")) & ~p["authority"].rlike("^:?@")) & (_scope(to) == _scope(seed))
    return F.when(F.coalesce(inside, F.lit(False)), F.concat(p["scheme"], F.lit("://"), F.lower(p["authority"]), F.coalesce(none_if_empty(p["path"]), F.lit("/"))))


def link_priority(url: Column) -> Column:
    """What to open first: paths with a telling word, then few levels, then the address itself. A struct to sort by."""
    path = F.lower(_parts(url)["path"])
    telling = F.lit(False)
    for word in PREFERRED_WORDS:
        telling = telling | F.contains(path, F.lit(word))
    return F.struct(F.when(telling, 0).otherwise(1).alias("rank"), (F.size(F.split(path, "/")) - 1).alias("depth"), url.alias("url"))
