"""Text expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, the information separators and NEL included, which \s alone is not.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The same as a list of characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
DASHES = "-–—"

# Language names that have a code.
LANGUAGE_CODES = {
    "swedish": "sv", "english": "en", "norwegian": "no", "danish": "da", "finnish": "fi", "german": "de",
    "french": "fr", "spanish": "es", "italian": "it", "dutch": "nl", "portuguese": "pt",
}
# Signs that start a list item.
BULLETS = "•▪◦‣·–\\-*"


def strip(c: Column) -> Column:
    """Trims by a list of characters: a pattern anchored at the end would be tried at every blank of an inner run."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}++", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def at_most_words(c: Column, n: int) -> Column:
    """word_count(c) <= n, read no further than the word after the n-th."""
    word = SPACE.replace("[", "[^", 1)
    return c.rlike(rf"\A{SPACE}*+(?:{word}++{SPACE}*+){{0,{n}}}+\z")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def last_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.array_join(F.when(F.size(w) > n, F.slice(w, -n, n)).otherwise(w), " ")


def unified_dashes(c: Column) -> Column:
    return F.translate(c, "−–—", "---")


def garbled_share(c: Column) -> Column:
    """Share of characters that betray a broken text layer: private use, U+FFFD, other control or
    unassigned ones; 0 for an empty text."""
    bad = F.regexp_count(c, F.lit(r"[\p{C}\x{FFFD}&&[^\n\r\t]]"))
    return F.when(F.length(c) > 0, bad / F.length(c)).otherwise(F.lit(0.0))


def is_garbled(c: Column, share: float = 0.10) -> Column:
    return garbled_share(c) >= share


def is_skip(description: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(strip(description)), F.lit("[SKIP]")), F.lit(False))


def shown(description: Column) -> Column:
    """The description, or nothing where it is missing or marks a skipped figure."""
    return F.when(is_skip(description) | description.isNull(), F.lit("")).otherwise(description)


def list_item(c: Column) -> Column:
    """The block as a Markdown item if its first line starts with a bullet, else null."""
    # White space after a bullet may not be the line's end.
    blank = SPACE[:-1] + r"&&[^\n\x0b\x0c\r\x85\u2028\u2029]]"
    return F.when(strip(c).rlike(f"^[{BULLETS}]{blank}"), F.concat(F.lit("- "), F.regexp_replace(squeeze(c), f"^[{BULLETS}] ", "")))


def is_page_number(c: Column) -> Column:
    """A number of up to four digits, after "page" or not, alone or out of a total, between dashes and blanks."""
    bare = F.btrim(c, F.lit(SPACES + DASHES))
    number, gap = r"\p{Nd}{1,4}", f"{SPACE}++"
    total = f"(?:{SPACE}*+/{SPACE}*+|{gap}of{gap}){number}"
    return bare.rlike(f"(?i)^(?:page{gap})?{number}(?:{total})?$")


def fingerprint(*parts: Column, length: int = 10) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


def language_code(name: Column) -> Column:
    pairs = [F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(strip(name)))


def language_name(answer: Column) -> Column:
    """A model's one-word answer without white space and full stops around it."""
    return strip(F.btrim(strip(answer), F.lit(".")))


def duration(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    whole = F.floor(seconds).cast("long")
    h, m, s = (F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def blockquote(c: Column) -> Column:
    lines = F.split(strip(c), r"\R")
    return F.array_join(F.transform(lines, lambda x: F.when(strip(x) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def clean_grid(cells: Column) -> Column:
    return F.transform(cells, lambda row: F.transform(row, lambda c: squeeze(F.coalesce(c, F.lit("")))))


def grid_width(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))


def markdown_table(cells: Column) -> Column:
    """Rows padded to one width, | escaped, a rule under the first; empty for no cells."""
    width = grid_width(cells)

    def line(row: Column) -> Column:
        full = F.concat(F.transform(row, lambda c: F.replace(squeeze(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))
        return F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 2_000_000_000)), "\n")
    return F.when((F.coalesce(F.size(cells), F.lit(0)) > 0) & (width > 0), table).otherwise(F.lit(""))


def is_numeric_cell(c: Column) -> Column:
    bare = strip(unified_dashes(F.coalesce(c, F.lit(""))))
    return (bare != "") & bare.rlike(r"-?\p{Nd}[\p{Nd},]*\.?\p{Nd}*") & (F.regexp_count(bare, F.lit(r"\p{L}")) <= 2)


def numeric_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(unified_dashes(c), F.lit(r"(-?\p{Nd}[\p{Nd},]*\.?\p{Nd}*)"), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))
