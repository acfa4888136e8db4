"""Identity and structure of addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only say where a click came from.
TRACKING_PARAMETERS = ["gclid", "fbclid", "msclkid", "dclid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl", "ref_src"]
TRACKING_PREFIX = "utm_"

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _piece(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _SPLIT, group)


def scheme(url: Column) -> Column:
    """Scheme in lower case, empty if none."""
    return F.lower(_piece(url, 1))


def netloc(url: Column) -> Column:
    """Host with port (and user), in lower case."""
    return F.lower(_piece(url, 2))


def path(url: Column) -> Column:
    """Path as written, empty if none."""
    return _piece(url, 3)


def query(url: Column) -> Column:
    """Query as written, without the mark."""
    return _piece(url, 4)


def hostname(url: Column) -> Column:
    """Host in lower case without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def normalize_url(url: Column) -> Column:
    """One spelling for addresses that differ without meaning.

    Scheme and host in lower case; default port, fragment, tracking parameters and empty parameters
    dropped; repeated slashes joined; an empty path is ``/``; parameters in the order of their names,
    those of one name as they came. Path case, final slash, ``www`` and valueless parameters stay.
    """
    s, host = scheme(url), netloc(url)
    host = F.when((s == "http") & host.endswith(":80"), F.regexp_replace(host, r":80$", "")).when(
        (s == "https") & host.endswith(":443"), F.regexp_replace(host, r":443$", "")
    ).otherwise(host)
    where = F.regexp_replace(path(url), r"/{2,}", "/")
    where = F.when(where == "", "/").otherwise(where)
    name = lambda p: F.substring_index(p, "=", 1)
    plain = lambda p: F.lower(F.coalesce(F.try_url_decode(F.replace(name(p), F.lit("+"), F.lit("%2B"))), name(p)))
    kept = F.filter(
        F.split(query(url), "&"),
        lambda p: (p != "") & ~plain(p).startswith(TRACKING_PREFIX) & ~plain(p).isin(TRACKING_PARAMETERS),
    )
    ordered = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p"))))
    rest = F.array_join(F.transform(ordered, lambda x: x["p"]), "&")
    front = F.concat(F.when(s != "", F.concat(s, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""))
    return F.concat(front, where, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))


def same_registrable_domain(url: Column, root_netloc: Column) -> Column:
    """Whether host and root are equal or one is a subdomain of the other (ports count)."""
    host, root = netloc(url), F.lower(root_netloc)
    return (host == root) | host.endswith(F.concat(F.lit("."), root)) | root.endswith(F.concat(F.lit("."), host))


def project_domain(address: Column) -> Column:
    """Project key: host name in lower case without one ``www.`` and the port; a bare host is taken as such."""
    full = F.when(F.trim(address).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.trim(address)).otherwise(F.concat(F.lit("https://"), F.trim(address)))
    return F.regexp_replace(hostname(full), r"^www\.", "")


def rank_key(url: Column) -> Column:
    """Key for rank targets: no fragment, query, scheme, ``www.`` and final slashes; case counts."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[#?][\s\S]*$", ""), r"^https?://", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"/+$", "")


def domain_of(url: Column) -> Column:
    """Domain of a result: host name without ``www.``."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def metrics_key(url: Column) -> Column:
    """Key of bulk metrics: trimmed, no final slashes, lower case."""
    return F.lower(F.regexp_replace(F.trim(url), r"/+$", ""))


def segment_of(url: Column, start_url: Column) -> Column:
    """Cluster of a page: ``home`` for the start page or a bare host, else ``/`` and the first path segment."""
    bare = lambda u: F.regexp_replace(u, r"/+$", "")
    first = F.try_element_at(
        F.filter(F.split(path(url), "/"), lambda x: x != ""), F.lit(1)
    )
    return F.when((bare(url) == bare(start_url)) | first.isNull(), "home").otherwise(F.concat(F.lit("/"), first))


def parameter_count(url: Column) -> Column:
    """Distinct names of query parameters with a value."""
    valued = F.filter(F.split(query(url), "&"), lambda p: p.rlike(r"^[^=]*=[\s\S]+$"))
    return F.size(F.array_distinct(F.transform(valued, lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)))))


def with_scheme(address: Column) -> Column:
    """An address with ``https://`` before it where it has no scheme."""
    return F.when(F.lower(address).rlike(r"^https?://"), address).otherwise(F.concat(F.lit("https://"), address))
