"""Text cleaning as column expressions; two families, as curated rows and feeds are keyed differently.

All take and give Columns. Null gives null, and so does what has nothing left. JVM expressions throughout but for
Unicode composition and numeric entities, which Spark has no function for.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"
WIDE_SPACE = r"(?U)[\s\x{A0}\x{200B}-\x{200D}\x{FEFF}]+"


def word(pattern: str) -> str:
    """Whole words by ASCII rules in any regex engine version: accented letters end a word."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def _squeeze(c: Column, pattern: str = SPACE) -> Column:
    return F.trim(F.regexp_replace(c, pattern, " "))


def clean_text(c: Column) -> Column:
    return _none(_squeeze(c))


def wide_clean(c: Column) -> Column:
    """Also folds no-break and zero-width spaces."""
    return _squeeze(c, WIDE_SPACE)


def company_key(c: Column) -> Column:
    """Curated rows: lower case, no punctuation, without one legal form at the end."""
    plain = _squeeze(F.regexp_replace(F.lower(F.trim(c)), "[.,'\"()]", ""))
    return F.trim(F.regexp_replace(plain, word("co|company|corp|corporation|gmbh|inc|incorporated|llc|ltd|plc") + "$", ""))


def title_key(c: Column) -> Column:
    """Curated rows: lower case, dashes as spaces, ASCII letters, digits and underscores only; accents vanish."""
    dashes = F.regexp_replace(F.lower(F.trim(c)), "[-–—]", " ")
    return _squeeze(F.regexp_replace(dashes, r"(?U)[^A-Za-z0-9_\s]", ""))


def title_family(c: Column) -> Column:
    """``title_key`` without season and year of this century."""
    return _squeeze(F.regexp_replace(title_key(c), word("fall|winter|spring|summer|20[0-9]{2}"), ""))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def case_insensitive_key(c: Column) -> Column:
    """For comparing whatever the case: composed characters, single spaces, lower case."""
    return F.lower(_squeeze(nfc(c)))


NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "bull": "•",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "amp": "&",
}


def decode_named(c: Column) -> Column:
    """Named entities, each once: the ampersand comes last, so that what it uncovers stays as it is."""
    for name, value in NAMED.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


@F.pandas_udf(StringType())
def decode_numeric(s: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]

    pattern = re.compile(r"&#(?:(\d{1,6})|x([0-9a-fA-F]{1,6}));", re.A)
    return s.map(lambda v: None if v is None else pattern.sub(one, v))


def decode_entities(c: Column) -> Column:
    """Named, then numeric entities; unknown ones stay."""
    return decode_numeric(decode_named(c))


BLOCKS = "article|blockquote|br|div|h[1-6]|li|ol|p|pre|section|table|tbody|thead|tr|ul"


def strip_tags(c: Column) -> Column:
    scripts = F.regexp_replace(c, r"(?i)<(style|script)[^>]*>[\s\S]*?</\1>", " ")
    blocks = F.regexp_replace(scripts, rf"(?i)</?({BLOCKS})[^>]*>", " ")
    return F.regexp_replace(blocks, "<[^>]*>", " ")


def html_to_text(c: Column, numeric: bool = True) -> Column:
    """Readable text of HTML. Without ``numeric`` it stays in the JVM and leaves numeric entities."""
    text = strip_tags(c)
    return _none(wide_clean(decode_entities(text) if numeric else decode_named(text)))


def employer_name(c: Column, full: bool = True) -> Column:
    """Feeds: keeps punctuation, knows more legal forms. Without ``full`` no composition and no numeric entities."""
    text = wide_clean(decode_entities(nfc(c)) if full else decode_named(c))
    forms = word("ag|bv|co|company|corp|corporation|gmbh|inc|incorporated|limited|llc|ltd|nv|plc|sa|srl")
    return _none(F.trim(F.regexp_replace(F.lower(text), rf"(?U)\s*{forms}\.?$", "")))


def job_title(c: Column, full: bool = True) -> Column:
    """Feeds: text of markup, lower case, long dashes as hyphens; letters and digits of any script, hyphen and slash."""
    text = F.coalesce(html_to_text(c, full), _none(c))
    text = F.lower(wide_clean(decode_entities(text) if full else decode_named(text)))
    text = F.regexp_replace(text, "[–—]", "-")
    return _none(_squeeze(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s/-]", " ")))


def job_title_family(c: Column, full: bool = True) -> Column:
    return family_of(job_title(c, full))


def family_of(normal: Column) -> Column:
    """A normalized title without season and year."""
    return _none(_squeeze(F.regexp_replace(normal, word("autumn|fall|winter|spring|summer|(?:19|20)[0-9]{2}"), "")))


def location_key(c: Column, full: bool = True) -> Column:
    text = F.lower(wide_clean(decode_entities(nfc(c)) if full else decode_named(c)))
    return _none(_squeeze(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s,.-]", " ")))


def department_key(c: Column, full: bool = True) -> Column:
    return _none(F.lower(wide_clean(decode_entities(nfc(c)) if full else decode_named(c))))


def initials(c: Column) -> Column:
    """Capitals of the first two words that begin with an ASCII letter; "?" where there is none."""
    words = F.slice(F.filter(F.split(c, SPACE), lambda w: w.rlike("^[A-Za-z]")), 1, 2)
    letters = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(letters == "", "?").otherwise(letters)


def search_term(value: str | None) -> str | None:
    """A parameter made safe for a substring search: no pattern or filter signs."""
    s = re.sub(r"\s+", " ", re.sub(r"[,()%_\\.]", " ", value or "")).strip()
    return s or None


def identity_key(source: str, token: Column, external_id: Column) -> Column:
    return F.concat(F.lit(source + ":"), F.lower(F.trim(token)), F.lit(":"), F.trim(external_id.cast("string")))
