"""Text normalisation for names: columns in, columns out.

Accents are stripped by decomposition, which Spark has no function for; a vectorised function
does only that, and only where a text has characters beyond ASCII does it change anything.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words cut from the front of producer names (the first that fits) and from the back, words cut out
#: of wine names (one after the other), and company forms. Accented forms and those with "&" cannot occur in
#: normalised names; " pere et fils" cannot either, as " et fils" is cut first.
PREFIXES = [
    "domaine de la", "domaine du", "domaine de", "domaine des", "domaine",
    "chateau", "clos", "mas", "cave", "caves",
    "maison", "famille",
    "bodega", "bodegas", "vina",
    "tenuta", "azienda agricola", "azienda vinicola", "azienda",
    "cantina", "fattoria", "podere", "cascina",
    "weingut", "schloss",
    "quinta da", "quinta de", "quinta do", "quinta dos", "quinta",
    "herdade", "casa",
    "the",
]
SUFFIXES = ["winery", "vineyards", "vineyard", "wines", "wine", "estate", "cellars", "cellar", "et fils", "brothers", "family"]
NOISE = [" gift box", " gift set", " magnum", " half bottle", " jeroboam", " double magnum", " imperial", " methuselah", " balthazar"]
LEGAL = [r"Inc\.?", "LLC", r"Ltd\.?", r"S\.?A\.?S\.?", r"S\.?r\.?l\.?", "GmbH", r"S\.?A\.?", r"S\.?L\.?", "AG", r"Co\.?", r"Corp\.?", r"Pty\.?", r"Ltda\.?"]
PRODUCT_PATTERNS = [r"\b(?:19|20)[0-9]{2}\b", r"\b[0-9]+ *ml\b", r"\b(?:375|750|1500|3000)\b", r"\b[0-9]+ *l\b"]
PARTICLES = ["de", "du", "des", "di", "da", "del", "della", "von", "van", "der", "la", "le", "of", "the", "and"]
#: Letters of Greek and Cyrillic and how they are written in Latin ones.
GREEK = {"α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o"}
CYRILLIC = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "", "ю": "yu", "я": "ya"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Texts that accents and compositions can be in; the others stay out of Python.
NOT_ASCII = r"[^\x00-\x7F]"


@F.arrow_udf(T.StringType())
def _without_marks(text: pa.Array) -> pa.Array:
    return pa.array(("".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") if (t := x.as_py()) is not None else None for x in text), pa.string())


@F.arrow_udf(T.StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array((unicodedata.normalize("NFC", t) if (t := x.as_py()) is not None else None for x in text), pa.string())


def strip_accents(c: str | Column) -> Column:
    """NFD without non-spacing marks."""
    col = _col(c)
    return F.coalesce(_without_marks(F.when(col.rlike(NOT_ASCII), col)), col)


def compose(c: str | Column) -> Column:
    """NFC."""
    col = _col(c)
    return F.coalesce(_composed(F.when(col.rlike(NOT_ASCII), col)), col)


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def normalise(c: str | Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces; null becomes empty."""
    plain = F.lower(strip_accents(F.coalesce(_col(c), F.lit(""))))
    return _tidy(F.regexp_replace(plain, "[^a-z0-9 ]", " "))


def slug(c: str | Column, drop_apostrophes: bool = False) -> Column:
    """Lower-case words joined by hyphens."""
    plain = F.lower(strip_accents(F.coalesce(_col(c), F.lit(""))))
    if drop_apostrophes:
        plain = F.regexp_replace(plain, "['’]", "")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def producer(c: str | Column) -> Column:
    """A normalised name without one leading and one trailing producer word."""
    front = F.regexp_replace(normalise(c), "^(?:" + "|".join(PREFIXES) + ") ", "")
    return F.trim(F.regexp_replace(front, " (?:" + "|".join(SUFFIXES) + ")$", ""))


def product(c: str | Column) -> Column:
    """A normalised name without years, bottle sizes and noise words."""
    out = normalise(c)
    for pattern in PRODUCT_PATTERNS:
        out = F.regexp_replace(out, pattern, "")
    for word in NOISE:
        out = F.replace(out, F.lit(word), F.lit(""))
    return _tidy(out)


def retail(c: str | Column) -> Column:
    """Lower case, punctuation to spaces, without years of the last century and of 2010 to 2029."""
    plain = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9 ]", " ")
    return _tidy(F.regexp_replace(plain, r"\b(?:19[0-9]{2}|20[12][0-9])\b", " "))


def year(c: str | Column) -> Column:
    """The first year 19xx or 20xx; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(_col(c), r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")), F.lit("9999")).cast("int")


def trigrams(c: str | Column) -> Column:
    """The distinct trigrams of the text with two spaces before it and one after."""
    padded = F.concat(F.lit("  "), _col(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def word_trigrams(c: str | Column) -> Column:
    """The distinct trigrams of the words of a text (letters and digits, in lower case), each word padded by itself: order does not count."""
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(words, trigrams)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def drop_words(c: str | Column, words: list[str]) -> Column:
    return _tidy(F.regexp_replace(_col(c), r"\b(?:" + "|".join(words) + r")\b", " "))


LEGAL_FORM = r"(?i)\s*,?\s*\b(?:" + "|".join(LEGAL) + r")\s*$"


def drop_legal_form(c: str | Column) -> Column:
    """Without the company form that the name ends with."""
    return F.trim(F.regexp_replace(_col(c), LEGAL_FORM, ""))


#: Bottle formats as (pattern, name, millilitres), the first that fits.
FORMATS = [
    (r"(?i)\(6\s*Liter\)", "6L", 6000),
    (r"(?i)\(3\s*Liter\)", "Jeroboam", 3000),
    (r"(?i)\(Magnum\s*1?\.?5?L?\)", "Magnum", 1500),
    (r"(?i)Magnum\s*1\.5L", "Magnum", 1500),
    (r"(?i)\(Half\s*Bottle\s*375\s*mL\)", "Half Bottle", 375),
    (r"(?i)375\s*mL", "Half Bottle", 375),
    (r"(?i)500\s*mL", "500ml", 500),
]


def bottle_format(c: str | Column) -> Column:
    """struct(name, ml, rest): the format named in a title, and the title without it."""
    col = _col(c)
    part = lambda name, ml, rest: F.struct(F.lit(name).alias("name"), F.lit(ml).alias("ml"), rest.alias("rest"))
    out = part("Standard", 750, col)
    for pattern, name, ml in reversed(FORMATS):
        out = F.when(col.rlike(pattern), part(name, ml, F.trim(F.regexp_replace(col, pattern, "")))).otherwise(out)
    return out


def trailing_vintage(c: str | Column) -> Column:
    """struct(vintage, rest): the year or NV that ends a title, and the title before it."""
    col, dated, undated = _col(c), r"\b((?:19|20)[0-9]{2})\s*$", r"(?i)\bNV\s*$"
    part = lambda year, rest: F.struct(year.cast("int").alias("vintage"), F.trim(rest).alias("rest"))
    return F.when(col.rlike(dated), part(F.regexp_extract(col, dated, 1), F.regexp_replace(col, dated, ""))).otherwise(part(F.lit(None), F.regexp_replace(col, undated, "")))


def transliterate(c: str | Column) -> Column:
    """Greek and Cyrillic in Latin letters."""
    table = GREEK | CYRILLIC
    table |= {k.upper(): v if k == "ъ" else v.capitalize() for k, v in table.items() if k != "ς"}
    out = _col(c)
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    single = {k: v for k, v in table.items() if len(v) == 1}
    return F.translate(out, "".join(single), "".join(single.values()))


def title_case(c: str | Column) -> Column:
    """Words capitalised, particles in lower case unless they come first."""
    words = F.split(F.lower(_col(c)), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(F.initcap(w))), " ")


#: The entities that text of HTML may hold, and their characters; the ampersand comes last.
BASIC_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&eacute;": "é", "&egrave;": "è", "&rsquo;": "’", "&amp;": "&"}


def _replaced(c: Column, table: dict[str, str]) -> Column:
    for k, v in table.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_html(c: str | Column) -> Column:
    """Text of HTML: block tags end lines, other tags and scripts go, common entities are decoded."""
    out = F.regexp_replace(_col(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/h[1-6])[^>]*>", "\n")
    out = _replaced(F.regexp_replace(out, "<[^>]+>", ""), BASIC_ENTITIES)
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n[ \n]*", "\n"))


#: Entities and tags, and what stands for them, in the order in which they are replaced.
ENTITIES = {
    "&ldquo;": "\u201c", "&rdquo;": "\u201d", "&lsquo;": "\u2018", "&rsquo;": "\u2019", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&nbsp;": " ",
    "&eacute;": "é", "&egrave;": "è", "&ocirc;": "ô", "&agrave;": "à", "&uuml;": "ü", "&ouml;": "ö", "&aacute;": "á", "&iacute;": "í",
    "&ntilde;": "ñ", "&ccedil;": "ç", "&mdash;": "\u2014", "&ndash;": "\u2013", "&hellip;": "\u2026", "&deg;": "°",
    "<br>": " ", "<br/>": " ", "<br />": " ",
}
#: White space, as in Unicode, for regular expressions of Java and of RE2.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def decode_entities(c: str | Column) -> Column:
    """Named and numeric entities decoded, runs of white space made one space, trimmed."""
    parts = F.split(_replaced(_col(c), ENTITIES), "&#")
    code = lambda x: F.regexp_extract(x, "^0*([0-9]{1,7});", 1)
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(code(x).try_cast("long")), 8, "0")), "UTF-32")
    known = lambda x: (code(x) != "") & (code(x).try_cast("long") <= 0x10FFFF) & ~code(x).try_cast("long").between(0xD800, 0xDFFF)
    decoded = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.when(known(x), F.concat(char(x), F.regexp_replace(x, "^[0-9]+;", ""))).otherwise(F.concat(F.lit("&#"), x)))
    text = F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))
    return F.regexp_replace(F.regexp_replace(text, SPACE + "{2,}", " "), f"^{SPACE}+|{SPACE}+$", "")


@F.arrow_udf(T.StringType())
def unescape(text: pa.Array) -> pa.Array:
    """All entities of HTML 5, for which Spark has no function."""
    return pa.array([t if t is None or "&" not in t else html.unescape(t) for t in text.to_pylist()], pa.string())


def clean(c: str | Column) -> Column:
    """Without null bytes, entities decoded, trimmed; empty becomes null."""
    return F.nullif(F.regexp_replace(unescape(F.replace(_col(c), F.lit("\0"), F.lit(""))), f"^{SPACE}+|{SPACE}+$", ""), F.lit(""))


def snippet(c: str | Column, term: str, before: int = 40, after: int = 80) -> Column:
    """The surroundings of the first hit with ellipses where text is cut; null without a hit."""
    col = _col(c)
    at = F.locate(term.lower(), F.lower(col))
    start = F.greatest(at - before, F.lit(1))
    size = at + len(term) + after - start
    body = F.substring(col, start, size)
    left, right = F.when(start > 1, "...").otherwise(""), F.when(start + size - 1 < F.length(col), "...").otherwise("")
    return F.when(at > 0, F.concat(left, body, right))
