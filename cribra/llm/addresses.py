"""Canonical page addresses and instants, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.text import barrier

#: Query parameters that say how a link was shared or shown, not which page it leads to. Fixed values.
TRACKING = r"(?:utm_\w+|_ga|_gl|gclid|gclsrc|dclid|fbclid|igshid|igsh|mc_cid|mc_eid|msclkid|twclid|yclid|ttclid|wbraid|gbraid|_hsenc|_hsmi|mkt_tok|spm|ref|ref_src|referrer|share|shared|ncid|cmpid|wt_mc|s_cid)"
VIEW = r"(?:amp|amp_js_v|print|printer|printable|imprimir|view|vista|output|outputtype|m|mobile|movil|version)"


def canonical_url(url: Column) -> Column:
    """The page a link leads to, without protocol, host prefix (www, m, amp ...), port, fragment, tracking, AMP, print
    and mobile view, escapes, trailing slash and order of parameters. Other host sections, ids, page numbers and parts
    (video, gallery) stay. Null and blank give null; text that is no address gives itself, trimmed."""
    return _assembled(_decoded(_bare(url)))


def with_page(df: DataFrame, url: Column, name: str) -> DataFrame:
    """Adds canonical_url(url); each step is computed once, as its result comes out of a generator."""
    df = barrier(barrier(df, "__bare", _bare(url)), "__decoded", _decoded(F.col("__bare")))
    return barrier(df, name, _assembled(F.col("__decoded"))).drop("__bare", "__decoded")


def _bare(url: Column) -> Column:
    """Without white space around and without fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"#.*$", "")


def _decoded(u: Column) -> Column:
    """Only escapes that can't change the structure are decoded."""
    plain = F.try_url_decode(F.regexp_replace(u, r"\+", "%2B"))
    harmless = F.contains(u, F.lit("%")) & u.rlike("%(?!2[36F]|3[DF]|25)[0-9A-Fa-f]{2}") & ~u.rlike("(?i)%(?:2[36f]|3[df]|25)")
    return F.when(harmless, F.coalesce(plain, u)).otherwise(u)


def _assembled(u: Column) -> Column:
    u = F.regexp_replace(u, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    host = F.regexp_replace(host, r"^[^@]*@|:(?:80|443)?$|\.$", "")
    host = F.regexp_replace(host, r"^(?:(?:www\d?|m|amp|mobile|movil|wap)\.)+(?=[^.]+\.)", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/{2,}", "/")
    path = F.regexp_replace(path, r"(?i)/index\.(?:html?|php)$", "/")
    path = F.regexp_replace(path, r"(?i)(?:/+(?:amp|print|imprimir))*/*$", "")
    path = F.regexp_replace(path, r"(?i)^/amp(?=/)", "")
    path = F.regexp_replace(path, r"(?i)\.amp(?=\.html?$|$)", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, r"[&;]"), lambda p: (p != "") & ~p.rlike(f"(?i)^(?:{TRACKING}|{VIEW})(?:=.*)?$")))
    tail = F.array_join(kept, "&")
    c = F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))
    return F.when(c != "", c)


#: MD5 and SHA-1 of nothing, and of common stand-ins: they say nothing of the content. Fixed values.
EMPTY_HASHES = ("d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709")


def content_key(content_hash: Column) -> Column:
    """The hash in lower case; null where it is missing, blank, all one digit, or the hash of an empty body."""
    h = F.lower(F.trim(content_hash))
    return F.when((h != "") & ~h.isin(*EMPTY_HASHES, "null", "none", "nan") & ~h.rlike(r"^(.)\1*$"), h)


def instant(text: Column) -> Column:
    """Timestamp of an ISO text; without an offset it is UTC. Null if it can't be read."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(?i)(?:z|utc|gmt|[+-]\d\d:?\d\d)$") & t.rlike(r"\d:\d"), t).otherwise(F.concat(t, F.when(t.rlike(r"\d:\d"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp")
