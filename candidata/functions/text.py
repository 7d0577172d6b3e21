"""Column functions on text and lists of terms. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candidata.functions.binding import bind

# The characters Python's str.strip() removes.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The patterns e-mail addresses and phone numbers are found with.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(\+?\d{1,3}[\s\-]?)?(\(?\d{2,4}\)?[\s\-]?)?(\d{3,4}[\s\-]?\d{3,4}[\s\-]?\d{0,4})"

UNICODE = "(?U)"  # \b, \d and \s cover all of Unicode
CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    """Null, or nothing but white space; stops at the first visible character."""
    return ~F.coalesce(c.rlike(f"[^{SPACE}]"), F.lit(False))


def squash_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def normalize_email(c: Column) -> Column:
    """The first address in the text; without one the text stays as it is."""
    return F.coalesce(F.nullif(F.regexp_extract(c, UNICODE + EMAIL, 0), F.lit("")), c)


def normalize_phone(c: Column) -> Column:
    """The first number in the text, reduced to digits, signs and parentheses."""
    number = F.regexp_replace(
        F.regexp_extract(c, UNICODE + PHONE, 0), UNICODE + r"[^\d\+\-\(\)]", ""
    )
    return F.coalesce(F.nullif(number, F.lit("")), c)


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after digits, dots and apostrophes.

    `initcap` alone starts a new word only after a blank, so it is applied run by run.
    """
    runs = F.regexp_extract_all(c, F.lit(f"([{CASED}]+|[^{CASED}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_skills(c: Column, mode: str = "compat") -> Column:
    """Trimmed, title-cased skills without blanks and repeats, in order.

    compat: a skill is a repeat if its text *before* title-casing equals an earlier
    title-cased one, so lower-case repeats stay. strict: compare after title-casing.
    """
    stripped = F.transform(F.filter(c, lambda x: ~is_blank(x)), strip)
    titled = F.transform(stripped, title_case)
    if mode == "strict":
        return F.array_distinct(titled)
    if mode != "compat":
        raise ValueError(f"unknown mode: {mode}")
    return bind(
        F.struct(stripped.alias("raw"), titled.alias("titled")),
        lambda s: F.filter(
            s["titled"],
            lambda _, i: ~F.array_position(s["titled"], F.get(s["raw"], i)).between(1, i),
        ),
    )


def normalize_terms(c: Column) -> Column:
    """Terms of a comma-separated text: trimmed, without empty ones."""
    return term_list(F.split(c, ","))


def term_list(c: Column) -> Column:
    """Terms of a list column: trimmed, without empty ones."""
    return F.filter(F.transform(c, strip), lambda x: x != "")


def display_terms(c: Column) -> Column:
    return F.array_join(c, ", ")


def search_text(c: Column) -> Column:
    """Lower-case words of a text, each with one blank on both sides.

    Words end at white space, commas, semicolons and parentheses and lose trailing
    dots and colons; `c++`, `c#`, `node.js` and `brand#1` stay whole. A phrase
    occurs in a text if its search_text does, so that no word list is built.
    """
    spaced = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return F.regexp_replace(spaced, f"(?:[.:]*[{SPACE},;()]+)+", " ")


def search_words(c: Column) -> Column:
    """The words of search_text as an array."""
    return F.filter(F.split(search_text(c), " "), lambda x: x != "")


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whole-word search; both are search_texts. An empty phrase is nowhere."""
    return F.contains(haystack, needle) & (needle != " ")
