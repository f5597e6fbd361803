"""The text of HTML pages, block by block, by functions of columns."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that begin a block of their own.
BLOCKS = (
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul"
).split()
#: What is never shown, to its end or the page's.
HIDDEN = "|".join([r"<!--.*?(?:-->|\z)", *[rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "template", "noscript")]])
SPACES = r"[\x09-\x0D\x20\x{A0}]+"
#: Named characters. The ampersand isn't among them: it is read last, as what it makes isn't read again.
NAMED = {f"&{name};": chr(code) for name, code in name2codepoint.items() if name != "amp"} | {"&apos;": "'"}
BEGIN, NAMED_END = "\x01", "\x02"


def marked(html: Column) -> Column:
    """The page with each block's begin marked by its element's name, each end by a slash, and all other tags gone."""
    names = "|".join(BLOCKS)
    text = F.regexp_replace(F.translate(html, BEGIN + NAMED_END, "  "), f"(?is){HIDDEN}", " ")
    text = F.regexp_replace(text, rf"(?i)<({names})\b[^>]*>", f"{BEGIN}$1{NAMED_END}")
    text = F.regexp_replace(text, rf"(?i)</(?:{names})\b[^>]*>", f"{BEGIN}/{NAMED_END}")
    text = F.regexp_replace(text, r"(?i)<br\b[^>]*>", " ")
    return F.concat(F.lit(f"/{NAMED_END}"), F.regexp_replace(text, "<[/!?A-Za-z][^>]*>", ""))


def unescaped(text: Column) -> Column:
    """The text with character references read: decimal and hexadecimal ones, and those of NAMED; others stay."""
    pattern = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
    named = F.create_map(*[F.lit(x) for pair in sorted(NAMED.items()) for x in pair])

    def read(so_far: Column, reference: Column) -> Column:
        code = F.regexp_replace(reference, "[&#;]", "")
        number = F.when(code.rlike("^[xX]"), F.conv(F.substr(code, F.lit(2)), 16, 10)).otherwise(code)
        number = F.when(F.contains(reference, F.lit("#")), number).cast("long")
        fine = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        character = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        # An ampersand goes through its name, so that what it makes isn't read again.
        numbered = F.when(number == 38, "&amp;").otherwise(character)
        shown = F.when(number.isNotNull(), numbered).otherwise(F.coalesce(F.try_element_at(named, reference), reference))
        return F.replace(so_far, reference, shown)

    text = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), text, read)
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, block (from 1), tag and text of every block of every page.

    A block is what stands from the begin of an element of BLOCKS to the next begin or end of one, so what an element
    holds after an inner one is a block without a tag. White space runs are one space; blocks of elements stay when
    they are empty, others don't. A page without a block, an empty or null one, has an empty one. Hidden parts (comments,
    scripts, styles) are left out, to the page's end if they aren't closed. A ``>`` in an attribute ends its tag.
    """
    pieces = F.split(marked(F.coalesce(F.col(html), F.lit(""))), BEGIN)

    def block(piece: Column) -> Column:
        tag = F.lower(F.substring_index(piece, NAMED_END, 1))
        body = F.trim(F.regexp_replace(unescaped(F.substring_index(piece, NAMED_END, -1)), SPACES, " "))
        return F.struct(F.when(tag == "/", "").otherwise(tag).alias("tag"), body.alias("text"))

    found = F.filter(F.transform(pieces, block), lambda b: (b["tag"] != "") | (b["text"] != ""))
    none = F.array(F.struct(F.lit("").alias("tag"), F.lit("").alias("text")))
    rows = pages.select(key, found.alias("found"))
    rows = rows.select(key, F.posexplode(F.when(F.size("found") > 0, F.col("found")).otherwise(none)).alias("at", "b"))
    return rows.select(key, (F.col("at") + 1).cast("long").alias("block"), "b.tag", "b.text")


def page_text(html: Column) -> Column:
    """The text of a whole page in one line; null for null."""
    text = F.regexp_replace(marked(html), f"{BEGIN}[^{NAMED_END}]*{NAMED_END}|^/{NAMED_END}", " ")
    return F.trim(F.regexp_replace(unescaped(text), SPACES, " "))
