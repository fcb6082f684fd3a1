"""Text normalising and matching as Column expressions."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _fold_rules() -> tuple[str, str, dict[str, str]]:
    """All characters whose compatibility form has ASCII in it, by rule from Unicode: one to one, and one to several."""
    source, target, longer = [], [], {}
    for code in range(0xA0, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            longer[char] = plain
    return "".join(source), "".join(target), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _fold_rules()
_ENTRY, _VALUE = "\x1e", "\x1f"  # no compatibility form holds them
_LONGER_TEXT = _ENTRY.join(f"{k}{_VALUE}{v}" for k, v in _FOLD_LONGER.items())


def fold_ascii(col: Column | str) -> Column:
    """Accents and compatibility forms of all of Unicode folded to ASCII, what does not fold dropped; ASCII text passes untouched."""
    col = _c(col)
    pairs = F.str_to_map(F.lit(_LONGER_TEXT), F.lit(_ENTRY), F.lit(_VALUE))
    spelled = F.array_join(F.transform(
        F.split(col, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)), "")
    whole = F.when(col.rlike("[" + "".join(_FOLD_LONGER) + "]"), spelled).otherwise(col)
    folded = F.regexp_replace(F.translate(whole, _FOLD_FROM, _FOLD_TO), r"[^\x00-\x7F]", "")
    plain = (F.octet_length(col) == F.char_length(col)) & F.is_valid_utf8(col)  # a byte for each character is ASCII
    return F.when(~plain, folded).otherwise(col)


def squeeze(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def normalize_name(col: Column | str) -> Column:
    return F.upper(squeeze(fold_ascii(col)))


def normalize_address(col: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9 ]", " "))


def normalize_gender(col: Column | str) -> Column:
    first = F.upper(F.substring(F.trim(_c(col)), 1, 1))
    return F.when(first.isin("M", "F"), first)


def present(col: Column | str) -> Column:
    """The value, with an empty string counted as missing."""
    col = _c(col)
    return F.when(col != "", col)


def field_value(normalized: Column | str, raw: Column | str) -> Column:
    return F.coalesce(present(normalized), _c(raw))


def once(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` over values made once; what stands inside a lambda as it is would be made again for each of its items."""
    held = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(held), lambda h: body(*[h[f"v{k}"] for k in range(len(values))])), F.lit(0))


# ---- matching on token arrays -------------------------------------------------

def _sorted_tokens(text: Column, pattern: str) -> Column:
    """One pass over the text; splitting and filtering by lambdas would leave the compiled code."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def name_tokens(col: Column | str) -> Column:
    """Sorted distinct tokens of the normalised name; two names match or not by these alone."""
    return _sorted_tokens(F.upper(fold_ascii(col)), r"\S+")


def address_tokens(col: Column | str) -> Column:
    return _sorted_tokens(F.lower(_c(col)), "[a-z0-9]{2,}")


def tokens_subset(a: Column, b: Column) -> Column:
    """Every token of ``a`` equals a token of ``b`` or shares its initial where one is a single letter."""
    def known(x: Column) -> Column:
        first = F.substring(x, 1, 1)  # a longer token finds a single letter by its own first one
        return F.array_contains(b, x) | F.array_contains(b, first) | (
            (F.length(x) == 1) & F.exists(b, lambda y: F.substring(y, 1, 1) == x))

    return (F.size(a) > 0) & F.forall(a, known)


def name_tokens_agree(a: Column, b: Column) -> Column:
    return tokens_subset(a, b) | tokens_subset(b, a)


def address_tokens_agree(a: Column, b: Column, share: float = 0.7) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (smaller > 0) & (common / F.greatest(smaller, F.lit(1)) >= share)


def token_overlap(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def names_match(a: Column | str, b: Column | str) -> Column:
    return once(name_tokens_agree, name_tokens(a), name_tokens(b))


def addresses_match(a: Column | str, b: Column | str) -> Column:
    return once(address_tokens_agree, address_tokens(a), address_tokens(b))


# ---- similarity ----------------------------------------------------------------

def fold_name(value: str | None) -> str:
    """One name in capitals, ASCII only, single spaces; null is empty."""
    letters = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode()
    return " ".join(letters.upper().split())


def _longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Length and places of the longest common run, the earliest of equals."""
    best, runs = (0, 0, 0), [0] * (len(b) + 1)
    for i, letter in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, other in enumerate(b, 1):
            if letter == other:
                now[j] = runs[j - 1] + 1
                if now[j] > best[0]:
                    best = (now[j], i + 1 - now[j], j - now[j])
        runs = now
    return best


def shared_letters(a: str, b: str) -> int:
    """Letters in matching blocks: the longest common run, then the same left and right of it."""
    total, waiting = 0, [(a, b)]
    while waiting:
        left, right = waiting.pop()
        size, i, j = _longest_block(left, right)
        if size:
            total += size
            waiting += [(left[:i], right[:j]), (left[i + size:], right[j + size:])]
    return total


def ratio(a: str | None, b: str | None) -> float:
    """Share of letters in matching blocks, as written or with the words sorted, whichever is more; two decimals."""
    names = fold_name(a), fold_name(b)
    if not all(names):
        return 0.0
    length = sum(map(len, names))
    forms = (names, tuple(" ".join(sorted(n.split())) for n in names))
    return round(2 * max(shared_letters(*form) for form in forms) / length, 2)


@F.pandas_udf(T.DoubleType())
def string_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio; Spark has no built-in of this kind, so pairs go through Arrow."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def normalize_name_exact(values: pd.Series) -> pd.Series:
    """Full Unicode folding, for scripts beyond the table behind ``fold_ascii``."""
    return values.map(lambda v: None if v is None else fold_name(v))


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    a, b = normalize_name(a), normalize_name(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.bround(1 - F.levenshtein(a, b) / longest, 2)).otherwise(F.lit(0.0))


# ---- codes, labels, file names --------------------------------------------------

def clean_number(col: Column | str) -> Column:
    return F.regexp_replace(F.upper(_c(col)), r"[^A-Z0-9\-]", "")


def clean_query(col: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(col)), r"(?U)[^\w\s]", ""))


def title_code(col: Column | str) -> Column:
    return F.initcap(F.replace(_c(col), F.lit("_"), F.lit(" ")))


def base_name(col: Column | str) -> Column:
    return F.substring_index(F.replace(_c(col), F.lit("\\"), F.lit("/")), "/", -1)


def extension(name: Column | str) -> Column:
    """Lower-cased suffix with its dot; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(_c(name), r"^.+(\.[^./\\]+)$", 1))


def safe_file_name(col: Column | str) -> Column:
    folded = F.substring_index(_c(col), "/", -1)
    cleaned = F.regexp_replace(folded, r"[^A-Za-z0-9._\- ]+", "_")
    cleaned = F.regexp_replace(cleaned, r"^[ ._]+|[ ._]+$", "")
    return F.coalesce(present(F.substring(cleaned, 1, 200)), F.lit("upload"))


def strip_name_label(col: Column | str) -> Column:
    """Leading "full name:" style labels removed, however often they repeat."""
    label = r"(?i)^((full|holder|cardholder|resident|father'?s|mother'?s)?\s*names?\s*:?\s*)+"
    return F.trim(F.regexp_replace(_c(col), label, ""))


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def contains_any(col: Column | str, words: Iterable[str]) -> Column:
    return _c(col).rlike("(?:" + any_of(words) + ")")


def search_words(col: Column | str, most: int | None = None) -> Column:
    """Distinct lower-case words of 3 to 40 letters or digits, over the whole text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(_c(col)), F.lit("[a-z0-9]{3,40}"), F.lit(0)))
    return words if most is None else F.slice(F.array_sort(words), 1, most)
