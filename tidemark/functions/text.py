"""Text functions: Column -> Column, planned by Catalyst."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that search leaves out.
STOP_WORDS = "a an and are as at be by for from in into is it of on or that the this to with what whats where when who how any some there".split()
#: Words that identity keys leave out.
KEY_STOP_WORDS = "the a an at in on of and with to for".split()


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _accented() -> tuple[str, str]:
    """Letters that decompose canonically into one other and marks U+0300 to U+036F, and those others."""
    pairs = ((chr(i), re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", chr(i)))) for i in range(0xC0, 0x30000))
    some = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in some), "".join(b for _, b in some)


ACCENTED, PLAIN = _accented()


def strip_accents(c: Column) -> Column:
    """Text without accents: canonically decomposed, the combining marks gone. Hangul stays composed (strip_accents_any decomposes it too)."""
    plain = F.translate(F.regexp_replace(c, "[\u0300-\u036f]", ""), ACCENTED, PLAIN)
    return F.when(c.rlike("[^\\x00-\\x7F]"), plain).otherwise(c)


def _compatible() -> dict[str, str]:
    """What is left of letters in identity keys after NFKD: ASCII letters and digits, other characters as one space."""
    out = {}
    for i in range(0xA0, 0x30000):
        left = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", chr(i)))
        if left.strip():
            out[chr(i)] = left
    return out


_COMPATIBLE = _compatible()
#: Letters of which a mark, so a space, stays after an ASCII letter or digit.
MARKED = "".join(k for k, v in _COMPATIBLE.items() if len(v.strip()) == 1 and v[-1] == " ")


def compatibility_key(c: Column) -> Column:
    """Lower-case text as NFKD leaves it, as far as ASCII letters and digits go; marks and other characters become spaces."""
    single = {k: v.strip() for k, v in _COMPATIBLE.items() if len(v.strip()) == 1}
    several = {k: v for k, v in _COMPATIBLE.items() if k not in single}
    before, after = ("".join(k for k in single if _COMPATIBLE[k][at] == " ") for at in (0, -1))
    far = r"(?=[^\x00-\x7F])"  # none of the letters is ASCII: long classes are tried on the others only
    out = F.regexp_replace(F.regexp_replace(c, f"{far}([{after}])", "$1 "), f"{far}([{before}])", " $1")
    out = F.translate(out, "".join(single), "".join(single.values()))
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = lambda x: F.array_join(F.transform(F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(known, ch), ch)), "")
    whole = let(out, lambda x: F.when(x.rlike(f"{far}[{''.join(several)}]"), each(x)).otherwise(x))
    return F.when(c.rlike("[^\\x00-\\x7F]"), whole).otherwise(c)


@F.pandas_udf(T.StringType())
def strip_accents_any(s: pd.Series) -> pd.Series:
    """Any text, canonically decomposed, without combining marks U+0300 to U+036F."""
    return s.str.normalize("NFD").str.replace("[̀-ͯ]", "", regex=True)


def stem(t: Column) -> Column:
    """First rule that fires: -ies to -y and -ing (over four letters), -es, -s (over three)."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & t.endswith("ing"), cut(3))
        .when((n > 3) & t.endswith("es"), cut(2))
        .when((n > 3) & t.endswith("s"), cut(1))
        .otherwise(t)
    )


def tokens(c: Column, accents=strip_accents) -> Column:
    """Search terms of a text, in order: lower case, no accents, no possessive s, no stop words, stemmed. Null: none."""
    plain = F.regexp_replace(accents(F.lower(F.coalesce(c, F.lit("")))), r"['’]s\b", "")
    parts = F.split(plain, "[^a-z0-9]+")
    return F.transform(F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)), stem)


def key_text(c: Column, decompose=compatibility_key) -> Column:
    """Text of identity keys: lower case, decomposed, other characters than ASCII letters and digits to spaces, no stop words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    low = decompose(low) if decompose is not None else low
    out = F.regexp_replace(low, r"[^a-z0-9\s]", " ")
    out = F.regexp_replace(out, rf"\b({'|'.join(KEY_STOP_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def word_set(c: Column, **kw) -> Column:
    return F.array_distinct(F.filter(F.split(key_text(c, **kw), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def slug(c: Column, cut: int | None = 80) -> Column:
    """Lower case, runs of other characters to one hyphen, none at the ends; cut after that, so one may remain."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(out, 1, cut) if cut else out


def slug_end(x: Column, wanted: Column) -> Column:
    """Length of the shortest start of four letters or more whose slug is the given one; null if there is none.

    A start with the slug ends where the slug's words end, so one start is tried, not all; only where lower case has another length, all are.
    """
    same = lambda i: slug(F.substring(x, F.lit(1), i), None) == wanted
    words = F.concat(F.lit("^[^a-z0-9]*+"), F.replace(wanted, F.lit("-"), F.lit("[^a-z0-9]++")))
    end = let(F.length(F.regexp_substr(F.lower(x), words)), lambda e: F.when(wanted == "", 4).when(e.isNotNull(), F.greatest(F.lit(4), e)))
    one = F.when(wanted.rlike("^(?:[a-z0-9]+(?:-[a-z0-9]+)*+)?$"), let(end, lambda i: F.when(same(i), i)))
    every = F.get(F.filter(F.sequence(F.lit(4), F.greatest(F.length(x), F.lit(4))), same), F.lit(0))
    return F.when(F.length(F.lower(x)) == F.length(x), one).otherwise(every)


def title_key(c: Column, cut: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", ""), 1, cut)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Entities of common use; & last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def clean_html(c: Column) -> Column:
    """Text without tags and entities, spaces collapsed; null if nothing is left."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.trim(F.regexp_replace(out, "[\\s ]+", " "))
    return F.when(out != "", out)


def summary(c: Column, most: int = 400, back: int = 40) -> Column:
    """Collapsed text; a longer one is cut at `most`, back to its last space but by `back` at the most, and gets an ellipsis."""
    clean = collapse(F.coalesce(c, F.lit("")))
    head = F.substring(clean, 1, most)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # index of the last space
    space = F.when(F.instr(head, " ") == 0, F.lit(-1)).otherwise(space)
    cut = F.substring(head, F.lit(1), F.greatest(space, F.lit(most - back)))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(cut, F.lit("…")))


def any_of(patterns) -> str | None:
    r"""One pattern that matches where any of the patterns \b(a|b|...)\b does, alternatives by their first letter; None if one has another form."""
    by: dict[str, list[str]] = {}
    for p in patterns:
        whole = re.fullmatch(r"\\b\((.*)\)\\b", p)
        parts, depth = [""], 0
        for x in re.findall(r"\\.|[^\\]", whole[1], re.DOTALL) if whole else "[":
            depth += (x == "(") - (x == ")")
            if x == "[" or depth < 0:
                return None
            if x == "|" and not depth:
                parts.append("")
            else:
                parts[-1] += x
        if not all(re.match("[a-z0-9](?![?*+{])", x) for x in parts):
            return None
        for x in parts:
            by.setdefault(x[0], []).append(x[1:])
    return rf"\b(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by.items())})\b" if by else None


def classify(c: Column, rules, default: str = "other") -> Column:
    """Name of the first rule (name, pattern) that matches the text. Where one pattern can say so, texts that match none are read once, not once a rule."""
    text, some = F.lower(F.coalesce(c, F.lit(""))), any_of([p for _, p in rules])
    out = F.when(~text.rlike(some), F.lit(default)) if some else None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), F.lit(name)) if out is None else out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def contains_any_case(c: Column, part: str) -> Column:
    """Case-insensitive substring test; null holds nothing."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def hash_mod(c: Column, n: int) -> Column:
    """The SHA-1 of the text as one large integer, modulo n."""
    digits = F.split(F.sha1(c.cast("binary")), "")
    value = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + value(d)) % n)


#: What marks something as free of charge, or for families.
FREE = r"(?i)\bfree\b|\bno charge\b|\bcomplimentary\b"
FREE_ANYWHERE = r"(?i)free|no charge|complimentary"
FAMILY = r"(?i)kid|child|family|all ages|toddler|storytime"
FAMILY_CATEGORIES = ("family", "market", "festival")


def is_free(price: Column, title: Column) -> Column:
    """By the price; without one by the title."""
    has = F.coalesce(price, F.lit("")) != ""
    return F.when(has, price.rlike(FREE)).otherwise(F.coalesce(title.rlike(FREE), F.lit(False)))


def is_free_loose(price: Column, description: Column) -> Column:
    """By the price, or "free" anywhere in the description ("gluten-free" too)."""
    return F.coalesce(price.rlike(FREE_ANYWHERE), F.lit(False)) | F.coalesce(description.rlike("(?i)free"), F.lit(False))


def is_family(given: Column | None, title: Column, description: Column) -> Column:
    """What the record says, else by key words."""
    said = F.concat_ws(" ", title, description).rlike(FAMILY)
    return said if given is None else F.coalesce(given, said)


def markdown_links(c: Column, prefix: str = "") -> Column:
    """Targets of markdown links that begin with `prefix`, in order."""
    return F.regexp_extract_all(c, F.lit(rf"\]\(({prefix}[^)\s]+)\)"), F.lit(1))


def query_string(**params: Column) -> Column:
    """key=value pairs of the non-empty values, URL-encoded, joined by &."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in params.items()]
    return F.concat_ws("&", *parts)


def page_description(c: Column, most: int = 160) -> Column:
    """What a page's metadata says of an event: the first characters of its description."""
    return F.substring(c, 1, most)
