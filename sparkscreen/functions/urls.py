"""URLs and hosts: rule chain, canonical forms, address classes, policies."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kinds import struct
from .patterns import let

# Private IPv4 networks, names and suffixes, tracking parameters, longest URL.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32",
)
PRIVATE_V6 = ("::1/128", "fe80::/10", "fc00::/7", "::ffff:0:0/96", "2001:db8::/32", "ff00::/8")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source")
LONGEST_URL = 2048
_V4, _V6 = [ipaddress.ip_network(n) for n in PRIVATE_V4], [ipaddress.ip_network(n) for n in PRIVATE_V6]

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def v4_ranges() -> list[tuple[int, int]]:
    """The private networks as closed integer ranges, for a range predicate."""
    return [(int(n.network_address), int(n.broadcast_address)) for n in _V4]


def is_private_v4(number: Column) -> Column:
    out = F.lit(False)
    for lo, hi in v4_ranges():
        out = out | number.between(lo, hi)
    return out


def v4_number(host: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    p = F.split(host, r"\.")
    quad = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
    n = sum((F.get(p, F.lit(k)).try_cast("bigint") * (1 << (24 - 8 * k)) for k in range(1, 4)), F.get(p, F.lit(0)).try_cast("bigint") * (1 << 24))
    return F.when(host.rlike(quad) & ~host.endswith("."), n)


def parts(url: Column) -> dict[str, Column]:
    """scheme, authority, host, port, path and query, as written; host without brackets."""
    got = {n: F.regexp_extract(url, _PARTS, k) for k, n in enumerate(("scheme", "authority", "path", "query"), 1)}
    bare = F.regexp_replace(got["authority"], "^.*@", "")
    got["host"] = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, "^([^:]*)", 1))
    got["port"] = F.regexp_extract(bare, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    return got


def ascii_host(host: Column) -> Column:
    """Canonical form of an ASCII name or dotted quad: one trailing dot off, lower case; null if refused."""
    h = F.lower(F.regexp_replace(host, r"\.$", ""))
    label = r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"
    numeric = h.rlike(r"^[0-9.]+$")
    return F.when(numeric & v4_number(h).isNull(), None).when(h.rlike(label), h)


def blocklisted(host: Column) -> Column:
    return (host == "localhost") | host.endswith(".local") | host.endswith(".localhost")


def url_rule(url: Column) -> Column:
    """The first rule that refuses a search result's URL; null if none does.  For ASCII hosts."""
    value = F.regexp_replace(F.regexp_replace(url, r"^[\s\x1c-\x1f\x85\xa0]+", ""), r"[\s\x1c-\x1f\x85\xa0]+$", "")
    own = F.struct(url.alias("url"), value.alias("value"), *[c.alias(n) for n, c in parts(value).items()])
    return let(own, _first_rule)


def _first_rule(p: Column) -> Column:
    url, value = p["url"], p["value"]
    scheme, host = F.lower(p["scheme"]), p["host"]
    port_bad = (p["port"] != "") & (~p["port"].rlike("^[0-9]+$") | (p["port"].try_cast("bigint") > 65535))
    v6 = host.contains(":")
    number = v4_number(F.regexp_replace(host, r"\.$", ""))
    rules = [
        (url.isNull() | (value == ""), "missing"),
        (F.length(value) > LONGEST_URL, "too_long"),
        (value.rlike(r'[\x00-\x20\x7f-\x9f\s\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<>"{}|\\^`]'), "raw_chars"),
        (p["authority"].contains("[") & ~p["authority"].rlike(r"^(?:[^@]*@)?\[[0-9A-Fa-f:.]+(?:%[^\]]*)?\](?::.*)?$"), "unparseable"),
        (port_bad, "invalid_port"),
        (~scheme.isin("http", "https") | (host == ""), "parse"),
        (p["authority"].contains("@"), "userinfo"),
        (v6 & host.contains("%"), "zone_id"),
        (host.rlike(r"[\x00-\x1f\x7f #%/<>?@\[\\\]^|]"), "host_code_point"),
        (~v6 & ascii_host(host).isNull(), "host_encoding"),
        (number.isNotNull() & is_private_v4(number), "private_literal"),
        (blocklisted(ascii_host(host)), "blocklisted_name"),
    ]
    return F.coalesce(*[F.when(cond, token) for cond, token in rules])


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, port, path and query kept, no fragment and no user part."""
    p = parts(F.trim(url))
    host = F.lower(p["host"])
    netloc = F.concat(F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.when(p["port"] != "", F.concat(F.lit(":"), p["port"].try_cast("bigint").cast("string"))).otherwise(""))
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    path = F.when((p["path"] != "") & ~p["path"].startswith("/"), F.concat(F.lit("/"), p["path"])).otherwise(p["path"])
    return F.concat(F.lower(p["scheme"]), F.lit("://"), netloc, path, query)


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def cache_url(url: Column) -> Column:
    """The form that a cache key is made of: tracking parameters out, the rest sorted by name, no fragment, no trailing slash."""
    p = parts(url)
    path = F.when(p["path"] == "/", p["path"]).otherwise(F.regexp_replace(p["path"], "/+$", ""))
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")
    named = F.transform(pairs, lambda x, i: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), i.alias("i"), F.when(x.contains("="), _decoded(F.substr(x, F.instr(x, "=") + 1))).otherwise("").alias("v")))
    kept = F.filter(named, lambda x: ~F.lower(x["k"]).isin(*TRACKING))
    # Values of a repeated name stay in their order, behind its first place in the sorted names.
    query = F.array_join(F.transform(F.array_sort(kept), lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    return F.concat(F.lower(p["scheme"]), F.lit("://"), F.lower(p["authority"]), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def address_class(address: str) -> str | None:
    """private_literal, embedded_private, or None for a public address."""
    a = ipaddress.ip_address(address)
    if a.version == 4:
        return "private_literal" if any(a in n for n in _V4) else None
    if int(a) <= 1:
        return "private_literal"
    inner = a.ipv4_mapped or a.sixtofour or (a.teredo[1] if a.teredo else None)
    if inner is None and (int(a) >> 32 == 0x64FF9B << 64 or int(a) >> 32 == 0):
        inner = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)
    if inner is not None:
        return "embedded_private" if any(inner in n for n in _V4) else None
    return "private_literal" if any(a in n for n in _V6) else None


def canonical_host(host: str | None) -> dict:
    """host, kind (name, ipv4, ipv6) and reason of a refusal; never looks a name up."""
    refused = lambda r: {"host": None, "kind": None, "reason": r}
    if not host:
        return refused("host_empty")
    if ":" in host:
        try:
            ipaddress.IPv6Address(host)
        except ValueError:
            return refused("host_literal")
        return {"host": host.lower(), "kind": "ipv6", "reason": None}
    h = host.removesuffix(".")
    if not h or "" in h.split("."):
        return refused("host_empty_label")
    h = h.lower()
    if not h.isascii():
        try:
            import idna

            h = idna.encode(h, uts46=True).decode()
        except ImportError:
            return refused("host_encoding")
        except ValueError:
            return refused("host_encoding")
        h = h.removesuffix(".")
    elif not all(0 < len(x) < 64 and all(c.isalnum() or c in "-_" for c in x) for x in h.split(".")) or len(h) > 253:
        return refused("host_encoding")
    last = h.rsplit(".", 1)[-1]
    if last.isdigit() or last.startswith("0x"):
        try:
            return {"host": str(ipaddress.IPv4Address(h)), "kind": "ipv4", "reason": None}
        except ValueError:
            return refused("host_numeric")
    return {"host": h, "kind": "name", "reason": None}


@F.pandas_udf(struct("host string, kind string, reason string, class string"))
def host_info(host: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Canonical host with its address class, names in other scripts included."""
    for batch in host:
        rows = [canonical_host(h) for h in batch]
        for r in rows:
            r["class"] = address_class(r["host"]) if r["kind"] in ("ipv4", "ipv6") else None
        yield pd.DataFrame(rows, columns=["host", "kind", "reason", "class"])


def suffixes(host: Column) -> Column:
    """The host and what is left of it behind each dot, at least two labels long."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def matched_entries(hosts: DataFrame, policy: DataFrame, host_col: str = "host") -> DataFrame:
    """(host, tier, priority) of all policy entries (name, wildcard, tier, priority) that match: by equality, or by suffix for wildcards.

    Hosts are distinct, so a host that a third of all rows have counts once; the join is on equal names.
    """
    own = hosts.select(F.col(host_col).alias("host")).distinct()
    each = own.select("host", F.explode(suffixes(F.col("host"))).alias("name"))
    return each.join(policy, "name").where((F.col("host") == F.col("name")) | F.col("wildcard")).select("host", "tier", "priority")


def trust_tier(rows: DataFrame, policy: DataFrame, host_col: str = "host") -> DataFrame:
    """Adds ``tier``: that of the least priority that matches the host, else standard."""
    best = matched_entries(rows, policy, host_col).groupBy("host").agg(F.min_by("tier", "priority").alias("tier"))
    joined = rows.join(best.withColumnRenamed("host", host_col), host_col, "left")
    return joined.withColumn("tier", F.coalesce("tier", F.lit("standard")))


def within_budget(entries: DataFrame, budget: int, list_col: str = "list", pos_col: str = "pos", entry_col: str = "entry") -> DataFrame:
    """The leading entries of each list whose bytes, with a separator each, fit; a list is one bounded setting."""
    run = Window.partitionBy(list_col).orderBy(pos_col)
    return entries.withColumn("bytes_so_far", F.sum(F.octet_length(entry_col) + 1).over(run) - 1).where(F.col("bytes_so_far") <= budget)


def domain_entries(entries: DataFrame, budget: int, list_col: str = "list", pos_col: str = "pos", entry_col: str = "entry", deny_col: str = "deny") -> DataFrame:
    """Policy entries made canonical, with ``entry`` null for those that are dropped.

    A leading dot makes an entry stand for all names below it.  Names have two labels at least, but in a list of denied
    hosts, which may name one; addresses stand for themselves only.  Allowing lists end where their bytes, with a
    separator each, pass the budget; denying lists never do.  A list is one bounded setting.
    """
    run = Window.partitionBy(list_col).orderBy(pos_col)
    rows = entries.withColumn("_bytes", F.sum(F.octet_length(entry_col) + 1).over(run) - 1)
    rows = rows.withColumn("_plain", F.regexp_replace(entry_col, r"^\s+|\s+$", "")).withColumn("_below", F.startswith(F.col("_plain"), F.lit(".")))
    rows = rows.withColumn("_host", host_info(F.expr("if(_below, substring(_plain, 2), _plain)")))
    labels = F.size(F.split(F.col("_host.host"), r"\."))
    name = (F.col("_host.kind") == "name") & (F.length("_host.host") <= 253) & ((labels > 1) | (F.col(deny_col) & ~F.col("_below")))
    address = F.col("_host.kind").isin("ipv4", "ipv6") & ~F.col("_below")
    good = F.coalesce((name | address) & (F.col(deny_col) | (F.col("_bytes") <= budget)), F.lit(False))
    canonical = F.concat(F.when(F.col("_below") & ~F.col(deny_col), ".").otherwise(""), F.col("_host.host"))
    return rows.select(*[c for c in entries.columns if c != entry_col], F.when(good, canonical).alias(entry_col))


def denied_lists_fit(entries: DataFrame, budget: int, list_col: str = "list", entry_col: str = "entry") -> DataFrame:
    """(list, bytes, fits): a list of denied hosts is refused as a whole when its raw bytes pass the budget."""
    size = F.sum(F.octet_length(entry_col)) + F.count("*") - 1
    return entries.groupBy(list_col).agg(size.alias("bytes")).withColumn("fits", F.col("bytes") <= budget)


def domain_changed(chain: Column) -> Column:
    """Whether the first and last URL of a redirect chain have different authorities."""
    return (F.size(chain) > 1) & (F.lower(parts(F.get(chain, F.lit(0)))["authority"]) != F.lower(parts(F.element_at(chain, -1))["authority"]))
