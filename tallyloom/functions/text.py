"""Column functions on texts: normalisation, parsing, Thai marks, digests. All but edit_distance are JVM-side expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Thai code points by class.
TONE_MARKS = ("่", "้", "๊", "๋")
UPPER_VOWELS = ("ั", "ิ", "ี", "ึ", "ื", "็")
LOWER_VOWELS = ("ุ", "ู")
CONSONANTS = "ก-ฮ"
COMBINING = "ัิ-ฺ็-๎"

NONE = "none"


def collapse_whitespace(text: Column) -> Column:
    """Each run of Unicode white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_space(text: Column) -> Column:
    """Unicode white space goes from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


# What each kind of markup is replaced by, in this order, and marks that simply go.
MARKUP = (
    (r"(?is)<figure>.*?</figure>", " "),
    (r"(?is)<page_number>(.*?)</page_number>", " $1 "),
    (r"(?i)<br\s*/?>", " "),
    (r"</?[a-zA-Z][^>]*>", " "),
    (r"(?m)^\s{0,3}#{1,6}\s*", ""),
)
MARKS = ("**", "__", "`", "$")


def normalize_markup(text: Column) -> Column:
    """Structure goes, text stays: figures, tags, headings, emphasis, code and math marks, table bars, white space."""
    plain = reduce(lambda t, rule: F.regexp_replace(t, *rule), MARKUP, text)
    plain = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit("")), MARKS, plain)
    return collapse_whitespace(F.replace(plain, F.lit("|"), F.lit(" ")))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[a-zA-Z][^>]*>", " ")


def cut_partial_tag(text: Column) -> Column:
    """A tag left open at the end goes."""
    return F.regexp_replace(text, r"<[^<>]*\z", "")


def newlines(text: Column) -> Column:
    """CRLF and CR become LF; white space goes from the ends."""
    return strip_space(F.regexp_replace(text, r"\r\n?", "\n"))


def close_figure(text: Column) -> Column:
    """An unclosed figure is closed at the end."""
    opened = F.regexp_count(text, F.lit(r"(?i)<figure\b"))
    closed = F.regexp_count(text, F.lit(r"(?i)</figure>"))
    return F.when(opened > closed, F.concat(text, F.lit("</figure>"))).otherwise(text)


def is_wrapped(text: Column) -> Column:
    """The output is a JSON object that holds its text in one field."""
    return F.coalesce(text.rlike(r'^\s*\{\s*"natural_text"\s*:'), F.lit(False))


def parse_choice(text: Column) -> Column:
    """A or B, in either case and with white space around; anything else is null."""
    bare = F.upper(strip_space(text))
    return F.when(bare.rlike("^[AB]$"), bare)


def parse_status(text: Column) -> Column:
    return F.when(parse_choice(text).isNotNull(), "PARSED").otherwise("PARSER_FAILURE")


def leading_label(text: Column) -> Column:
    """The label that an answer begins with, or null."""
    return F.nullif(F.upper(F.regexp_extract(text, r"^\s*\(?([A-Ba-b])(?:[\s).:,]|$)", 1)), F.lit(""))


def has_thai(text: Column) -> Column:
    return text.rlike("[฀-๿]")


def thai_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[฀-๿]"))


def characters(text: Column) -> Column:
    """Code points, one string each."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def codepoints(text: Column) -> Column:
    """U+XXXX of each code point."""
    return F.transform(characters(text), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))


def component(char: Column) -> Column:
    """Class of a character by the marks it is one of."""
    return F.when(char.isin(*TONE_MARKS), "TONE").when(char.isin(*UPPER_VOWELS), "UPPER").when(char.isin(*LOWER_VOWELS), "LOWER").when(char.rlike(f"[{CONSONANTS}]"), "CONSONANT").otherwise("OTHER")


def clusters(text: Column) -> Column:
    """A consonant with the marks on it, or any other character by itself."""
    return F.regexp_extract_all(text, F.lit(f"(?s)[{CONSONANTS}][{COMBINING}]*|."), F.lit(0))


def mark_sites(text: Column) -> Column:
    """array<struct<kind, index, reference>>: marks, and consonants that carry none but have a character after them.

    Characters meet the ones after them in one array: an array named within a lambda would be made again for each of its elements.
    """
    chars = characters(text)

    def site(p: Column, i: Column) -> Column:
        c, after = p["c"], p["after"]
        kind = component(c)
        bare = (kind == "CONSONANT") & after.isNotNull() & ~after.rlike(f"[{COMBINING}]")
        name = F.when(kind.isin("TONE", "UPPER", "LOWER"), kind).when(bare, "TONE_ABSENT")
        return F.struct(name.alias("kind"), i.alias("index"), F.when(bare, NONE).otherwise(c).alias("reference"))

    pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.lit(1), F.length(text))), lambda c, after: F.struct(c.alias("c"), after.alias("after")))
    return F.filter(F.transform(pairs, site), lambda s: s["kind"].isNotNull())


def apply_variant(text: Column, kind: Column, index: Column, label: Column) -> Column:
    """The text with the mark at a site changed, or one put after a bare consonant."""
    mark = F.when(label == NONE, "").otherwise(label)
    head = F.substring(text, F.lit(1), F.when(kind == "TONE_ABSENT", index + 1).otherwise(index))
    return F.concat(head, mark, F.substr(text, index + 2))


def parse_box(text: Column) -> Column:
    """struct<x0, y0, x1, y1> of the first four numbers in brackets, or null."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    pattern = rf"\[{number},{number},{number},{number}\]"
    box = F.struct(*(F.regexp_extract(text, pattern, i + 1).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))
    return F.when(text.rlike(pattern), box)


def collapse_digits(text: Column) -> Column:
    """Each run of ASCII or Thai digits becomes 0."""
    return F.regexp_replace(text, "[0-9๐-๙]+", "0")


def length_ratio(output: Column, reference: Column) -> Column:
    return F.length(output) / F.greatest(F.lit(1), F.length(reference))


def decoded_contract(raw: Column) -> Column:
    """Why a decoded output breaks its contract, or null."""
    return F.when(raw.contains("�"), "REPLACEMENT_CHARACTER").when(strip_space(raw).rlike(r"(?U)\s"), "INTERNAL_WHITESPACE")


def classify_output(parsed: Column, target: Column, opposite: Column) -> Column:
    """Category of an output that should be a target exactly; the first that fits."""
    return (
        F.when(parsed == target, "EXACT_TARGET").when(parsed == opposite, "OPPOSITE_MEMBER").when(parsed == "", "EMPTY")
        .when(parsed.rlike(r"(?U)\s"), "WHITESPACE").when(has_thai(parsed), "OTHER_THAI").otherwise("NON_THAI")
    )


def canonical_member(choice: Column, orientation: Column) -> Column:
    """Member a or b that a choice A or B names under an orientation."""
    straight = orientation == "AB"
    return F.when(choice == "A", F.when(straight, "a").otherwise("b")).when(choice == "B", F.when(straight, "b").otherwise("a"))


def slug(text: Column, most: int = 60) -> Column:
    """Lower case, other characters than letters and digits as single dashes, cut at `most`."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def digest(seed: int | str, *parts: Column) -> Column:
    """Hexadecimal SHA-256 of seed and parts joined by colons: a stable order and a source of stable choices."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def digest_number(hex_: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(hex_, 1, digits), 16, 10).cast("long")


def join_reads(first: Column, second: Column) -> Column:
    return strip_space(F.concat_ws(" ", first, second))


def ordered_text(order: Column, text: Column, separator: str = "\n") -> Column:
    """Aggregate: texts joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda s: s["t"]), separator)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, null where a side is. Spark's own takes a step for each cell of the matrix, far too many for whole texts; see
    functions.reading.edit_distance, which this sends pairs to."""
    from tallyloom.functions.kernels import many_distances
    from tallyloom.functions.reading import edit_distance as distance  # they import this module

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = np.flatnonzero(x.notna() & y.notna())
        out = np.full(len(x), None, object)
        out[both] = many_distances(list(zip(x.iloc[both], y.iloc[both], strict=True)), distance)
        return pd.Series(out, dtype="Int32")

    return F.pandas_udf(run, "int")(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - edit_distance(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def cer(reference: Column, hypothesis: Column, clamp: bool = False) -> Column:
    """Edit distance over the reference's length. An empty reference is an error."""
    value = edit_distance(reference, hypothesis) / F.length(reference)
    value = F.least(F.lit(1.0), value) if clamp else value
    return F.when(F.length(reference) == 0, F.raise_error(F.lit("reference must not be empty")).cast("double")).otherwise(value)


def drift(reference: Column, other: Column) -> Column:
    return edit_distance(reference, other) / F.greatest(F.lit(1), F.length(reference))
