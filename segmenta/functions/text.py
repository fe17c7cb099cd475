"""Normalisation and other functions of texts: Column to Column, evaluated in the JVM.

Null texts count as empty unless a function says otherwise.  Java's ``\\s``, ``\\w`` and ``\\b`` know ASCII only, so white space
and the edges of words are spelled out (BLANK, WORD, ``edged``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: White space as Unicode has it, and the characters of words.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
# Classes of code points, as ranges.
ARABIC = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"
ARABIC_NARROW = "؀-ۿﭐ-﷿"
URDU_ONLY = "ٹپچڈڑژکگںھہۃیے"
URDU_SIGNS = URDU_ONLY + "ۓ۔"
MARKS = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭـ"
PUNCTUATION = "،؛؟«»‏‎​‌‍﻿'\"`.,!?():\\[\\]{}⟨⟩﴾﴿٪‘’“”\\-–—/\\\\"
INVISIBLE = "‌‍‎‏‪-‮﻿"
LATIN = "A-Za-zÀ-ɏ"
# Letters that one form stands for, and the form.
VARIANTS, PLAIN = "أإآٱؤئةى", "اااا" + "ويهي"
CROSS, CROSS_PLAIN = "ہیک", "هيك"
TO_URDU, URDU = "يىكة", "ییکۃ"


def members(characters: str) -> str:
    """The code points of the basic plane in a class."""
    own = re.compile(f"[{characters}]")
    return "".join(filter(own.match, map(chr, range(0xD800)))) + "".join(filter(own.match, map(chr, range(0xE000, 0x10000))))


def column(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def edged(pattern: str) -> str:
    """A pattern with ``\\b`` at its ends as look-around: combining marks don't count as parts of words."""
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{WORD})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?!{WORD})"
    return pattern.replace(r"\s", BLANK)


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value computed once: a lambda that names an outer expression would compute it for each element."""
    return F.get(F.transform(F.array(value), lambda x: make(x)), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def compose(text: Column) -> Column:
    """NFC, by the library that Spark brings for its collations: no text leaves the JVM.  Null counts as empty."""
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), column(text), F.lit(False))


@cache
def mapping(cross: bool) -> tuple[str, str]:
    """What normalisation makes of single characters, as ``translate`` takes it: those without a partner go."""
    signs = members(PUNCTUATION)
    own, plain = (VARIANTS + CROSS, PLAIN + CROSS_PLAIN) if cross else (VARIANTS, PLAIN)
    return own + signs + members(MARKS), plain + " " * len(signs)


def normalise_arabic(text: Column | str, *, nfc: bool = True) -> Column:
    """Marks gone, letter variants as one, punctuation and controls as spaces, white space collapsed; case is kept.

    One pass over the characters and one over white space.  nfc=False leaves composition out, for tables known to be
    composed.
    """
    text = compose(column(text)) if nfc else column(text)
    return collapse(F.translate(text, *mapping(False)))


def canonical(text: Column | str, *, nfc: bool = True) -> Column:
    """``normalise_arabic`` with Urdu letters as their Arabic ones: for matching only, never for output."""
    if nfc:
        return normalise_arabic(F.translate(column(text), CROSS, CROSS_PLAIN))
    return collapse(F.translate(column(text), *mapping(True)))


def normalise_urdu(text: Column | str) -> Column:
    """Urdu letter forms, no invisible controls, two or more blanks as one space.  Null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    shaped = F.regexp_replace(F.translate(text, TO_URDU, URDU), f"[{INVISIBLE}]", "")
    return F.regexp_replace(F.regexp_replace(shaped, BLANK + "{2,}", " "), f"^{BLANK}+|{BLANK}+$", "")


def has_arabic(text: Column | str) -> Column:
    return column(text).rlike(f"[{ARABIC}]")


def count_of(text: Column, characters: str) -> Column:
    """How many code points are in a class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]", ""))


def mainly_arabic(text: Column | str) -> Column:
    """More than 60 % of the script characters are Arabic ones that Urdu shares, and less than 20 % of the Arabic ones are Urdu's own."""
    text = column(text)
    urdu, block = count_of(text, URDU_ONLY), count_of(text, ARABIC_NARROW)
    arabic = block - urdu
    total = block + F.length(F.regexp_replace(F.regexp_replace(text, f"[{ARABIC_NARROW}]", ""), r"[^\p{L}]", ""))
    return (total > 0) & (arabic > 0.60 * total) & (urdu < 0.20 * F.greatest(block, F.lit(1)))


def words(text: Column) -> Column:
    """Words between white space; of a blank text none."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def arabic_spans(text: Column | str) -> Column:
    """Runs of two or more words with Arabic and without Urdu-only letters, where they look Arabic.

    A run counts if it has a vowel mark, a hamza carrier, a final form, or five words; else if its definite articles and
    function words are at least two, or one among three words.
    """
    plain = lambda w: w.rlike(f"[{ARABIC_NARROW}]") & ~w.rlike(f"[{URDU_ONLY}]")
    # other words become a separator; runs are what stands between them
    marked = F.array_join(F.transform(words(column(text)), lambda w: F.when(plain(w), w).otherwise(F.lit("\u0001"))), " ")
    runs = F.filter(F.transform(F.split(marked, "\u0001"), lambda r: F.trim(r)), lambda r: r.contains(" "))
    article = f"(?<!{WORD})ال{WORD}{{2,}}"
    own = F.array(*map(F.lit, lexicon.ARABIC_STOPWORDS))

    def accepted(run: Column) -> Column:
        parts = F.split(run, " ")
        signs = F.regexp_count(run, F.lit(article)) + F.size(F.array_intersect(parts, own))
        return run.rlike("[ً-ٰٟؤئأإةى]") | (F.size(parts) >= 5) | (signs >= F.when(F.size(parts) >= 3, 1).otherwise(2))

    return F.filter(runs, accepted)


def same_key(text: Column | str) -> Column:
    """White space collapsed and case folded; ß as ss."""
    return F.replace(F.lower(collapse(column(text))), F.lit("ß"), F.lit("ss"))


def replaced(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Rules (pattern, replacement) in order.

    A text in which no pattern is found stays as it is, rule after rule: one search for all of them spares most texts the rest.
    """
    some = "|".join(f"(?:{pattern})" for pattern, _ in rules)
    return F.when(text.rlike(some), reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), rules, text)).otherwise(text)


# Spellings of English terms, and what mixed-script damage is repaired to.
ENGLISH = (
    (r"\b[Ii]nsha\s*[Aa]llah\b", "Insha'Allah"),
    (r"\b[Mm]asha\s*[Aa]llah\b", "Masha'Allah"),
    (r"\b[Ss]ubhan\s*[Aa]llah\b", "SubhanAllah"),
    (r"\b[Aa]lhamdulillah\b", "Alhamdulillah"),
    (r"\b[Aa]llahu\s*[Aa]kbar\b", "Allahu Akbar"),
    (r"\b[Aa]staghfirullah\b", "Astaghfirullah"),
    (r"\b[Jj]azak\s*[Aa]llah\b", "JazakAllah"),
    (r"\b(?i:PBUH)\b", "صلى الله عليه وسلم"),
    (r"\bSAW\b", "صلى الله عليه وسلم"),
    (r"\bSWT\b", "سبحانه وتعالى"),
    (r"\bRA\b", "رضي الله عنه"),
)
REPAIRS = (
    (rf"الل[A-Za-z]{{1,4}}(?!{WORD})", "الله"),
    (rf"فر[Mm][Aa]?(?!{WORD})", "فرما"),
    (rf"بسم{BLANK}*الل[A-Za-z]{{1,4}}", "بسم الله"),
    (rf"([؀-ۿ]{{3,}})[{LATIN}]{{1,3}}(?={BLANK}|$)", "$1"),
    (rf"(?:^|{BLANK})[{LATIN}]{{1,3}}([؀-ۿ]{{3,}})", " $1"),
)
TRIM = (rf"^{BLANK}+|{BLANK}+$", "")


def repair_scripts(text: Column | str) -> Column:
    """Latin letters that leaked into Arabic words go."""
    return replaced(column(text), [*REPAIRS, TRIM])


def correct(text: Column | str) -> Column:
    """All corrections of a transcribed text: expansions, terms, English terms, mixed scripts, spaces.  Blank texts stay."""
    text = F.col(text) if isinstance(text, str) else text
    rules = [(edged(p), r) for p, r in lexicon.EXPANSIONS] + list(lexicon.TERMS) + [(edged(p), r) for p, r in ENGLISH] + [*REPAIRS, TRIM, (" {2,}", " "), TRIM]
    return F.when(text.rlike(rf"^{BLANK}*$"), text).otherwise(replaced(text, rules))


def roman_to_urdu(text: Column | str) -> Column:
    """Known phrases in Latin letters as Urdu; only whole phrases, in any case."""
    return replaced(F.col(text) if isinstance(text, str) else text, [(f"(?iu)(?<!{WORD}){p}(?!{WORD})", r) for p, r in lexicon.ROMAN_PHRASES])


def timestamp(seconds: Column | str, *, millis: bool = False, comma: bool = False) -> Column:
    """HH:MM:SS, with .mmm or ,mmm if asked; parts of a unit are cut, not rounded."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    whole = F.floor(s)
    out = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.concat(out, F.format_string(",%03d" if comma else ".%03d", F.floor((s - whole) * 1000))) if millis else out


def trigrams(text: Column | str) -> Column:
    """All runs of three characters, repeats included."""
    none = F.array().cast("array<string>")
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    return let(column(text), lambda t: F.when(F.length(t) >= 3, grams(t)).otherwise(none))


def word_windows(text: Column | str, least: int = 5, most: int = 12, chars: int = 20) -> Column:
    """Windows of words, the widest first, then from left to right, that have ``chars`` characters."""

    def windows(parts: Column) -> Column:
        sizes = F.when(F.size(parts) >= least, F.sequence(F.least(F.lit(most), F.size(parts)), F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))))

    return F.filter(let(words(column(text)), windows), lambda w: F.length(w) >= chars)


def distinctive_words(text: Column | str) -> Column:
    """How many words of three letters or more are not generic."""
    generic = F.array(*map(F.lit, lexicon.GENERIC_NARRATION_WORDS))
    return F.size(F.filter(words(column(text)), lambda w: (F.length(w) >= 3) & ~F.array_contains(generic, w)))


def repetitive(text: Column | str) -> Column:
    """Six words or more and a pair of words more than three times."""
    def pairs(parts: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws(" ", F.element_at(parts, i), F.element_at(parts, i + 1)))
        return F.when(F.size(parts) >= 6, F.array_sort(own)).otherwise(F.array().cast("array<string>"))

    def often(ordered: Column) -> Column:
        # after sorting, a pair that occurs four times stands equal three places apart
        places = F.when(F.size(ordered) > 3, F.sequence(F.lit(1), F.size(ordered) - 3)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda i: F.element_at(ordered, i) == F.element_at(ordered, i + 3))

    return let(let(words(column(text)), pairs), often)


def preview(text: Column | str, n: int = 60) -> Column:
    return F.substring(column(text), 1, n)


# Names of languages that recognisers give.
LANGUAGE_CODES = {"arabic": "ar", "ar": "ar", "urdu": "ur", "ur": "ur", "english": "en", "en": "en"}


def language_code(code: Column | str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(column(code))), F.lit("und"))
