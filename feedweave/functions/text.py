"""String functions as SQL expressions: extension stripping, slugs, text normalisation, show rules.

Every function takes and returns SQL text, so that the same definition serves DataFrames (``F.expr``), SQL views and
the comparison with another engine; ``Dialect`` holds the few places where engines differ.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool = True

    def text(self, value: str) -> str:
        value = value.replace("\\", "\\\\") if self.spark else value
        return "'" + (value.replace("'", "\\'") if self.spark else value.replace("'", "''")) + "'"

    def sub(self, x: str, pattern: str, new: str = "") -> str:
        """Replace every match; groups are written \\1."""
        if self.spark:
            return f"regexp_replace({x}, {self.text(pattern)}, {self.text(_dollars(new))})"
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(new)}, 'g')"

    def test(self, x: str, pattern: str) -> str:
        return f"{'rlike' if self.spark else 'regexp_matches'}({x}, {self.text(pattern)})"

    def group(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"


def _dollars(new: str) -> str:
    out = new.replace("$", "\\$")
    for i in range(10):
        out = out.replace(f"\\{i}", f"${i}")
    return out


SPARK, DUCK = Dialect(True), Dialect(False)

# Ligatures, symbols, number words and Roman numerals as they are spelt out, in order of application.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
SYMBOLS = {"@": " at ", "&": " and ", "+": " plus ", "%": " percent ", "#": " number ", "$": " dollar ", "=": " equals "}
NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16",
    "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50",
    "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000",
}
ROMAN = {"IV": "4", "VIII": "8", "VII": "7", "VI": "6", "V": "5", "IX": "9", "X": "10", "III": "3", "II": "2", "I": "1"}
SLUG_CHARS = 100
# What a slug does to transliterated text in lower case, in order.
SLUG_STEPS = (
    (r"([a-z]+)_s\b", r"\1's"),
    (r"\b([a-z]+)'([a-z]{1,2})\b", r"\1\2"),
    (r"[ _]", "-"),
    (r"[^a-z0-9-]", ""),
    (r"-+", "-"),
)
EXTENSION = r"\.[a-z34]+$"

#: Characters that become several letters, Cyrillic and Greek; other Latin letters are decomposed by rule.
SPELT = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ", "…": "...", "«": "<<", "»": ">>",
    "©": "(c)", "®": "(r)", "™": "(tm)", "€": "EUR", "½": " 1/2", "¼": " 1/4", "¾": " 3/4", "№": "No",
    "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia", "ё": "io",
    "Ж": "Zh", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ю": "Iu", "Я": "Ia", "Ё": "Io",
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "Θ": "Th", "Φ": "Ph", "Χ": "Kh", "Ψ": "Ps",
}
SINGLE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "–": "-", "—": "-", "‐": "-",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "•": "*", "×": "x", "·": "*", "¿": "?", "¡": "!", " ": " ", " ": " ", "　": " ",
    **dict(zip("абвгдезийклмнопрстуфыэАБВГДЕЗИЙКЛМНОПРСТУФЫЭ", "abvgdeziiklmnoprstufyeABVGDEZIIKLMNOPRSTUFYE", strict=True)),
    **dict(zip("αβγδεζηικλμνξοπρσςτυωΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΩ", "abgdezeiklmnxoprsstuoABGDEZEIKLMNXOPRSTUO", strict=True)),
    **dict(zip("άέήίόύώϊϋΆΈΉΊΌΎΏ", "aeeiouoiuAEEIOUO", strict=True)),
    "ь": "'", "ъ": '"', "Ь": "'", "Ъ": '"',
}


def _decomposed() -> dict[str, str]:
    """Latin letters with marks, up to U+1EFF, to their base letters."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]):
            out[c] = base[0]
    return out


_TABLE = {**_decomposed(), **SINGLE}


def transliterate(x: str, d: Dialect = SPARK) -> str:
    """Latin, Cyrillic and Greek letters to ASCII; what has no counterpart (CJK, symbols) is dropped."""
    for old, new in SPELT.items():
        x = f"replace({x}, {d.text(old)}, {d.text(new)})"
    x = f"translate({x}, {d.text(''.join(_TABLE))}, {d.text(''.join(_TABLE.values()))})"
    return d.sub(x, r"[^\x00-\x7F]+")


def remove_file_extension(x: str, d: Dialect = SPARK) -> str:
    """Drops a last dot and the letters, 3s and 4s after it: "a.mp3", but also "Vol.3" and not "Vol.2"."""
    return d.sub(x, r"(?di)\.[a-z34]+$") if d.spark else d.sub(x, r"(?i)\.[a-z34]+(\n?)$", r"\1")


def remove_control_chars(x: str, d: Dialect = SPARK) -> str:
    return d.sub(f"coalesce({x}, '')", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def create_slug(x: str, d: Dialect = SPARK) -> str:
    x = f"lower({transliterate(remove_file_extension(x, d), d)})"
    for pattern, new in SLUG_STEPS:
        x = d.sub(x, pattern, new)
    return f"substring(trim(BOTH '-' FROM {x}), 1, {SLUG_CHARS})" if d.spark else f"substring(trim({x}, '-'), 1, {SLUG_CHARS})"


def slug_of(name: str) -> str:
    """The slug of a name of the configuration: what create_slug() does to a column."""
    x = re.sub(EXTENSION, "", name, flags=re.I)
    for old, new in SPELT.items():
        x = x.replace(old, new)
    x = re.sub(r"[^\x00-\x7F]+", "", x.translate(str.maketrans(_TABLE))).lower()
    for pattern, new in SLUG_STEPS:
        x = re.sub(pattern, new, x)
    return x.strip("-")[:SLUG_CHARS]


def is_slug(x: str, d: Dialect = SPARK) -> str:
    return d.test(x, r"(?d)^[a-z0-9]+(-[a-z0-9]+)*$" if d.spark else r"^[a-z0-9]+(-[a-z0-9]+)*\n?$")


def ligatures(x: str, d: Dialect = SPARK) -> str:
    for old, new in LIGATURES.items():
        x = f"replace({x}, {d.text(old)}, {d.text(new)})"
    return x


def symbol_words(x: str, d: Dialect = SPARK) -> str:
    for old, new in SYMBOLS.items():
        x = f"replace({x}, {d.text(old)}, {d.text(new)})"
    return x


def roman_numerals(x: str, d: Dialect = SPARK) -> str:
    for old, new in ROMAN.items():
        x = d.sub(x, rf"(?i)\b{old}\b", new)
    return x


def number_words(x: str, d: Dialect = SPARK) -> str:
    """Whole words to digits, without composing them: "twenty one" becomes "20 1"."""
    for old, new in NUMBERS.items():
        x = d.sub(x, rf"(?i)\b{old}\b", new)
    return x


def ordinals(x: str, d: Dialect = SPARK) -> str:
    return d.sub(x, r"(?i)\b(\d+)(?:st|nd|rd|th)\b", r"\1")


def part_marker(x: str, d: Dialect = SPARK) -> str:
    return d.sub(x, r"(?i)\(Pt\.?\s*(I{1,3}|IV|V|\d+)\)", r"part \1")


def squeeze(x: str, d: Dialect = SPARK) -> str:
    """Punctuation and white space to single spaces, trimmed, in lower case."""
    return f"lower(trim({d.sub(d.sub(x, '[^A-Za-z0-9_ ]', ' '), ' +', ' ')}))"


def normalize_text(x: str, d: Dialect = SPARK) -> str:
    """The comparison form of a title or description."""
    x = transliterate(ligatures(remove_file_extension(x, d), d), d)
    x = roman_numerals(part_marker(x, d), d)
    return squeeze(ordinals(number_words(symbol_words(x, d), d), d), d)


@dataclass(frozen=True)
class Replacement:
    pattern: str
    replacement: str = ""
    target: str = "title"


@dataclass(frozen=True)
class TitleRules:
    """What a show does to its titles before they are compared."""

    prefix_patterns: tuple[str, ...] = ()
    suffix_patterns: tuple[str, ...] = ()
    slug_suffixes: tuple[str, ...] = ()
    replacements: tuple[Replacement, ...] = ()


def apply_title_rules(x: str, rules: TitleRules, d: Dialect = SPARK) -> str:
    flag = "(?dU)" if d.spark else ""
    for r in rules.replacements:
        if r.target == "title":
            x = d.sub(x, flag + r.pattern, r.replacement)
    for p in (*rules.prefix_patterns, *rules.suffix_patterns):
        x = d.sub(x, flag + p)
    return x


def apply_slug_rules(slug: str, rules: TitleRules, d: Dialect = SPARK) -> str:
    for r in rules.replacements:
        if r.target == "slug":
            slug = d.sub(slug, ("(?d)" if d.spark else "") + r.pattern, r.replacement)
    for suffix in rules.slug_suffixes:
        slug = d.sub(slug, f"-{slug_of(suffix)}$")
    return f"trim(BOTH '-' FROM {slug})" if d.spark else f"trim({slug}, '-')"


def normalize_title(x: str, rules: TitleRules = TitleRules(), d: Dialect = SPARK) -> str:
    return apply_slug_rules(create_slug(apply_title_rules(remove_control_chars(x, d), rules, d), d), rules, d)


def alignment_title(x: str, rules: TitleRules | None = None, d: Dialect = SPARK) -> str:
    """The form that titles are scored in: normalised text, of the normalised title where the show is known."""
    return normalize_text(x if rules is None else normalize_title(x, rules, d), d)

