"""Text functions over string columns, evaluated in the JVM but for rare characters and deep mails, which go to Python in batches."""

from __future__ import annotations

import base64
import html
import json
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words, phrases and tables that results depend on.
STOPWORDS = (
    "the a an of to in on for and or at by with from is are as it its this that "
    "i og å en et er på til av for som med det den de har om mot ved"
).split()
TEMPLATE_PHRASES = (
    "View image:",
    "Follow image link:",
    "View in browser",
    "·Member",
    "Today's highlights",
    "Please use an email client supporting HTML email",
)
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
HEADER_ASCII = {"⚠": "!", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "å": "a", "Å": "A", "—": "-", "–": "-"}
URL_PATTERN = r"https?://[^\s<>\"']+(?:\([^\s<>\"']*\)[^\s<>\"']*)*"
KEYWORD_PATTERN = "[a-zA-ZæøåÆØÅ0-9]{4,}"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: White space of any script, and the separators of files, groups, records and units.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column | str) -> Column:
    """White space, no-break and other wide spaces included, to single spaces; trimmed."""
    return F.trim(F.regexp_replace(_column(text), SPACE, " "))


def clean_for_embedding(text: Column | str, own_phrases: Iterable[str] = ()) -> Column:
    """Drop tags, URLs and phrases of mail templates, then collapse white space.

    `own_phrases` are further phrases, such as a newsletter's greeting of its reader.
    """
    phrases = [*TEMPLATE_PHRASES, *own_phrases]
    out = F.regexp_replace(_column(text), "<[^>]+>", " ")
    out = F.regexp_replace(out, r"https?://\S+", " ")
    quoted = "|".join("".join(c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c for c in p) for p in phrases)
    return collapse(F.regexp_replace(out, f"(?iu){quoted}", " "))


#: What `html.unescape` reads as a reference.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _all_references(found: pd.Series) -> pd.Series:
    return found.map(lambda references: [list(references), [html.unescape(r) for r in references]], na_action="ignore")


def decode_references(text: Column | str) -> Column:
    """Character references, named and numeric, as browsers read them.

    The commonest six are read in the JVM. Of texts with any other the distinct references go to Python, in
    batches, and never the texts, which may be long.
    """
    text = _column(text)
    rest = text.rlike(r"&(?!(?:lt|gt|quot|nbsp|amp|#39);)[#A-Za-z]|&amp;#?\w")
    out = text
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(char))
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    told = _all_references(F.when(rest, F.array_distinct(found)))  # the references, and what they stand for
    pieces = F.arrays_zip(F.split(text, REFERENCE, -1).alias("t"), found.alias("r"))  # the text between them, and they
    char = lambda x, r: F.try_element_at(x["told"][1], F.array_position(x["told"][0], r).cast("int"))
    read = lambda x: F.array_join(F.transform(x["pieces"], lambda p: F.concat(p["t"], F.coalesce(char(x, p["r"]), F.lit("")))), "")
    both = F.when(told.isNotNull(), F.struct(told.alias("told"), pieces.alias("pieces")))
    return F.coalesce(F.transform(F.array(both), read)[0], out)


def html_to_text(source: Column | str, limit: int = 500) -> Column:
    """Plain text of a feed's HTML: references first, then CDATA marks and tags; empty keyword lines go."""
    out = decode_references(F.coalesce(_column(source), F.lit("")))
    out = F.regexp_replace(out, r"<!\[CDATA\[", " ")
    out = F.regexp_replace(out, r"\]\]>", " ")
    out = collapse(F.regexp_replace(out, "<[^>]+>", " "))
    return F.left(F.trim(F.regexp_replace(out, r"(?i)\s*Stikkord:\s*null\s*$", "")), F.lit(limit))


def escape_html(text: Column | str) -> Column:
    """Ampersand and angle brackets as references."""
    out = F.coalesce(_column(text), F.lit(""))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), out)


def escape_xml(text: Column | str) -> Column:
    """`escape_html`, and both quotes too."""
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def keywords(text: Column | str) -> Column:
    """Distinct words of four letters or digits and more, lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_column(text), F.lit(""))), F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)]))


def outbound_urls(text: Column | str) -> Column:
    """URLs of a text, one level of parentheses included."""
    return F.regexp_extract_all(F.coalesce(_column(text), F.lit("")), F.lit(URL_PATTERN), F.lit(0))


def trim_url(url: Column | str) -> Column:
    """A URL without the punctuation of the sentence around it; `)` stays if the URL has any `(`."""
    url = _column(url)
    return F.when(url.contains("("), F.regexp_replace(url, "[.,;:!?]+$", "")).otherwise(F.regexp_replace(url, "[.,;:!?)]+$", ""))


def tail_slug(text: Column | str) -> Column:
    """The last 32 characters of an ASCII slug, or `untitled`."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(_column(text), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.right(F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled")), F.lit(32))


def page_slug(text: Column | str) -> Column:
    """The first 50 characters of a slug that keeps letters of all scripts."""
    slug = F.regexp_replace(_column(text), r"(?U)[^\w\-]+", "-")
    return F.left(F.lower(F.regexp_replace(slug, "^-+|-+$", "")), F.lit(50))


def note_name(item_id: Column | str) -> Column:
    """File name of an item's note."""
    return F.concat(F.regexp_replace(_column(item_id).cast("string"), r"(?U)[^\w\-]", ""), F.lit(".md"))


def guess_language(text: Column | str) -> Column:
    """`no` for Norwegian letters, `und` for nothing, else `en`."""
    text = F.coalesce(_column(text), F.lit(""))
    return F.when(F.trim(text) == "", "und").when(text.rlike("[æøåÆØÅ]"), "no").otherwise("en")


def latin_key(text: Column | str) -> Column:
    """Lower case with Cyrillic letters in Latin ones."""
    out = F.lower(_column(text))
    single = {c: t for c, t in CYRILLIC.items() if len(t) == 1}
    for char, latin in CYRILLIC.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(char), F.lit(latin))
    return F.translate(out, "".join(single), "".join(single.values()))


def ascii_header(text: Column | str) -> Column:
    """A header value: the first line in ASCII, 80 characters, unknown characters as `?`."""
    lines = F.split(F.trim(F.coalesce(_column(text), F.lit(""))), r"\r\n|[\n\r]")
    out = F.element_at(lines, 1)
    for char, latin in HEADER_ASCII.items():
        out = F.replace(out, F.lit(char), F.lit(latin))
    return F.left(F.regexp_replace(out, r"[^\x00-\x7F]", "?"), F.lit(80))


def snippet(text: Column | str, limit: int = 500) -> Column:
    """The first characters of a text with single spaces."""
    return F.left(collapse(text), F.lit(limit))


def first_line(text: Column | str, otherwise: Column) -> Column:
    """The trimmed first line, or `otherwise` if it is empty."""
    line = F.trim(F.element_at(F.split(F.coalesce(_column(text), F.lit("")), "\n"), 1))
    return F.coalesce(F.nullif(line, F.lit("")), otherwise)


def comma_list(text: Column | str) -> Column:
    """The trimmed, non-empty parts of a list with commas."""
    parts = F.transform(F.split(F.coalesce(_column(text), F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def base64url_text(data: Column | str) -> Column:
    """UTF-8 text of unpadded base64url; null if it isn't valid."""
    return F.try_to_binary(F.translate(_column(data), "-_", "+/"), F.lit("base64")).cast("string")


def strip_thinking(text: Column | str) -> Column:
    """A model's answer without its reasoning span."""
    return F.trim(F.regexp_replace(_column(text), "(?s)<think>.*?</think>", ""))


def blank_to_null(text: Column | str) -> Column:
    """Null for a text of nothing but white space of any script."""
    text = _column(text)
    return F.when(~text.rlike(r"(?U)^\s*$"), text)


def tool_payload(response: Column | str) -> Column:
    """The JSON text that a tool's answer holds as the text of its first content; null if there is none."""
    inner = F.get_json_object(_column(response), "$.result.content[0].text")
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


#: Levels of a mail's parts that are read in the JVM; mails with more go to Python.
MAIL_LEVELS = 4


@F.pandas_udf(StringType())
def _deep_mail_text(payloads: pd.Series) -> pd.Series:
    def first(payload: str) -> str | None:
        open_ = [json.loads(payload)]
        while open_:
            part = open_.pop()
            if not isinstance(part, dict):
                continue
            data = (part.get("body") or {}).get("data")
            if part.get("mimeType") == "text/plain" and data:
                found = base64.b64decode(data + "=" * (-len(data) % 4), b"-_").decode("utf-8", "replace")
                if found:
                    return found
            open_ += reversed(part.get("parts") or [])
        return None

    def read(payload: str) -> str | None:
        try:
            return first(payload)
        except (ValueError, RecursionError, AttributeError):
            return None

    return payloads.map(read, na_action="ignore")


def mail_text(payload: Column | str) -> Column:
    """The first plain text among the parts of a mail's JSON payload, depth first, however deep they lie.

    Parts have mimeType, body.data (unpadded base64url) and parts. Null if there is none, and for what isn't JSON.
    Mails with up to MAIL_LEVELS levels below the first, which is nearly all, never leave the JVM.
    """
    part = "mimeType: string, body: struct<data: string>"
    kind = f"{part}, parts: array<string>"
    for _ in range(MAIL_LEVELS):
        kind = f"{part}, parts: array<struct<{kind}>>"

    def walk(p: Column, below: int) -> tuple[Column, Column]:
        """(texts, whether parts lie below the levels) of a part."""
        data = p["body"]["data"]
        own = F.when((p["mimeType"] == "text/plain") & (data != ""), F.array(base64url_text(data))).otherwise(F.array().cast("array<string>"))
        if not below:
            return own, F.coalesce(F.size(p["parts"]) > 0, F.lit(False))
        parts = F.coalesce(p["parts"], F.array())
        return F.concat(own, F.flatten(F.transform(parts, lambda q: walk(q, below - 1)[0]))), F.exists(parts, lambda q: walk(q, below - 1)[1])

    payload = _column(payload)
    texts, deeper = walk(F.from_json(payload, f"struct<{kind}>"), MAIL_LEVELS)
    shallow = F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(1))
    return F.when(F.coalesce(deeper, F.lit(False)), _deep_mail_text(F.when(deeper, payload))).otherwise(shallow)


def wiki_links(text: Column | str, names: Iterable[str]) -> Column:
    """A text with the given names as wiki links: the longest name first, at word boundaries, not in links or URLs.

    `names` is a registry on the driver; it becomes one pattern, which takes URLs and links whole
    so that names in them stay as they are.
    """
    ordered = sorted({n for n in names if n}, key=lambda n: (-len(n), n))
    text = _column(text)
    if not ordered:
        return text
    quoted = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in ordered)
    keep = r"https?://\S+|\[\[[^\]]*\]\]|\[[^\]]*\]"
    marked = F.regexp_replace(text, rf"(?U)({keep})|\b({quoted})\b", "$1\u0001$2\u0002")
    # What was kept has an empty name behind it.
    return F.regexp_replace(F.replace(marked, F.lit("\u0001\u0002"), F.lit("")), "\u0001([^\u0002]*)\u0002", "[[$1]]")
