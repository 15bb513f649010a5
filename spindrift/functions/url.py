"""URL keys: a JVM path for ordinary URLs, an Arrow function for the exact rules of URL parsers."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindrift.functions.text import wide_clean

#: Query parameters that only track; curated rows drop the first group, by exact case, feeds all, in any case.
CURATED_TRACKING = ("ref", "src", "trk", *(f"utm_{x}" for x in ("campaign", "content", "medium", "source", "term")))
FEED_TRACKING = CURATED_TRACKING + ("_hsenc", "_hsmi", "fbclid", "gclid", "hsctatracking", "mc_cid", "mc_eid", "msclkid", "utm_id")


def _with_scheme(c: Column) -> Column:
    return F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))


def canonical_url(c: Column) -> Column:
    """Feeds: no fragment, no tracking parameters in any case, no slash at the end of a path; null unless HTTP.

    For URLs without upper-case hosts, default ports, or characters that parsers would escape; ``canonical_url_exact``
    covers those.
    """
    u = F.regexp_replace(_with_scheme(wide_clean(c)), "#.*$", "")
    u = F.regexp_replace(u, rf"(?i)(?<=[?&])(?:{'|'.join(FEED_TRACKING)})=[^&]*(?:&|$)", "")
    u = F.regexp_replace(u, "[?&]$", "")
    u = F.when(u.rlike("^[a-zA-Z]+://[^/?]+$"), F.concat(u, F.lit("/"))).otherwise(u)
    u = F.when(u.rlike("^[a-zA-Z]+://[^/]+/.*/$"), F.regexp_replace(u, "/$", "")).otherwise(u)
    return F.when((F.trim(c) != "") & u.rlike("(?i)^https?://"), u)


def curated_url(c: Column) -> Column:
    """Curated rows: fewer parameters, by exact case; one slash at the end goes even at the root."""
    u = F.regexp_replace(_with_scheme(F.trim(c)), "#.*$", "")
    u = F.regexp_replace(u, rf"(?<=[?&])(?:{'|'.join(CURATED_TRACKING)})=[^&]*(?:&|$)", "")
    u = F.regexp_replace(F.regexp_replace(u, "[?&]$", ""), "/$", "")
    return F.when((F.trim(c) != "") & u.rlike("(?i)^https?://"), u)


_PATH_SAFE = "!$%&'()*+,-./:;=@[]^_|~"


def _form(pairs: list[tuple[str, str]]) -> str:
    return "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in pairs).replace("~", "%7E")


def exact(url: str | None, tracking: tuple[str, ...], any_case: bool, always_form: bool, root_slash: bool) -> str | None:
    """One URL by the rules of URL parsers: host in lower case, default port gone, query in form encoding where it changed."""
    raw = re.sub(r"[\s ​-‍﻿]+", " ", url or "").strip()
    if not raw:
        return None
    try:
        parts = urlsplit(raw if "://" in raw else "https://" + raw)
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), (parts.hostname or "").lower()
    if scheme not in ("http", "https") or not host or re.search(r"[\s<>^|%]", host):
        return None
    user = parts.netloc.rpartition("@")[0]
    place = (user + "@" if user else "") + host + (f":{port}" if port and port != {"http": 80, "https": 443}[scheme] else "")
    path = quote(parts.path or "/", safe=_PATH_SAFE)
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    kept = [(k, v) for k, v in pairs if (k.lower() if any_case else k) not in tracking]
    query = _form(kept) if always_form or len(kept) < len(pairs) else quote(parts.query, safe=_PATH_SAFE + "?/`{}")
    out = f"{scheme}://{place}{path}" + (f"?{query}" if query else "")
    if out.endswith("/") and (root_slash is False or len(path) > 1):
        out = out[:-1]
    return out


@F.pandas_udf(StringType())
def canonical_url_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda u: exact(u, FEED_TRACKING, True, False, True))


@F.pandas_udf(StringType())
def curated_url_exact(s: pd.Series) -> pd.Series:
    return s.map(lambda u: exact(u, CURATED_TRACKING, False, True, False))


def board_token(value: str) -> str:
    """A board's token in its canonical form, or ValueError: what isn't plain can't reach a URL."""
    token = value.strip().lower()
    if len(token) > 128 or not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", token):
        raise ValueError(f"not a board token: {value!r}")
    return token


def board_url(token: str, base: str = "https://boards-api.greenhouse.io") -> str:
    """Where a board's jobs are listed with their texts; only a plain token gets there, never a link."""
    return f"{base}/v1/boards/{board_token(token)}/jobs?content=true"
