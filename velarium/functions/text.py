"""Text cleaning, analysis and snippets as column expressions; Arrow functions where Spark has no built-in."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from velarium.shared import ship

#: Characters that readers of images confuse (fixed values).
LOOK_ALIKES = {"0": ["o"], "1": ["l", "i"], "rn": ["m"]}


def clean_text(c: Column) -> Column:
    """Drop control characters but line ends and tabs, join words hyphenated across white space, make runs of white space one space."""
    kept = F.regexp_replace(c, r"[\p{C}&&[^\n\t]]", "")
    joined = F.regexp_replace(kept, r"([\p{L}\p{N}_]+)-\s+([\p{L}\p{N}_]+)", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\s{2,}", " "))


def nfc(c: Column) -> Column:
    """Unicode normal form C."""
    import unicodedata

    @F.arrow_udf("string")
    def normal(x: pa.Array) -> pa.Array:
        return pa.array([None if (v := s.as_py()) is None else v if v.isascii() else unicodedata.normalize("NFC", v) for s in x], pa.string())

    return normal(c)


def terms(c: Column) -> Column:
    """Lower-case terms of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def ngrams(c: Column, n: int = 3) -> Column:
    """Character n-grams of a string; shorter strings have none. One pass looks ahead from each character, line ends and those beyond 16 bits included."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))


def plain_letters(s: str) -> str:
    """Lower case without accents: marks that normal form D parts from their letters go, and so do the strokes of STROKED."""
    import unicodedata

    s = s.lower()
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).translate(_STROKED)


#: Letters with strokes or ligatures, which no normal form takes apart, and what stands for them (fixed values).
STROKED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "þ": "th", "ŧ": "t"}
_STROKED = str.maketrans(STROKED)


def without_accents(c: Column) -> Column:
    """Lower-case letters without their accents."""
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def of(x: pa.Array) -> pa.Array:
        return pa.array([None if (v := s.as_py()) is None else plain_letters(v) for s in x], pa.string())

    return of(c)


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """How often a run of vowels is followed by a run of consonants."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _holds_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one no w, x or y."""
    n = len(w)
    return n >= 3 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


#: Suffixes of the Porter algorithm's steps 2, 3 and 4, longest first where one ends another (fixed values).
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
STEP_4 = "ement ment ance ence able ible ant ent ion al er ic ou ism ate iti ous ive ize".split()


def porter(w: str) -> str:
    """The stem of a lower-case English word by the Porter algorithm (1980); words of up to two letters and words beyond ASCII letters stay."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    # plurals, -ed and -ing
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and _holds_vowel(w[: -len(e)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) >= 2 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _holds_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP_2, STEP_3):
        hit = max((rule.split(":") for rule in step if w.endswith(rule.split(":")[0])), key=lambda r: len(r[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    last = max((e for e in STEP_4 if w.endswith(e)), key=len, default=None)
    if last:
        rest = w[: -len(last)]
        if _measure(rest) > 1 and (last != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stem(word: str) -> str:
    """A light suffix stripper for English: plurals, -ed, -ing, -ly, final e. `porter` is the full algorithm."""
    w = word
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix) and len(w) - len(suffix) >= 2:
            w = w[: len(w) - len(suffix)] + put
            break
    for suffix in ("ingly", "edly", "ing", "ed", "ly"):
        rest = w[: -len(suffix)]
        if w.endswith(suffix) and any(v in "aeiouy" for v in rest) and len(rest) >= 2:
            w = rest if len(rest) < 2 or rest[-1] != rest[-2] or rest[-1] in "lsz" else rest[:-1]
            break
    return w[:-1] if w.endswith("e") and len(w) > 4 else w


def stems(c: Column) -> Column:
    """The stems of an array of terms."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def of(x: pa.Array) -> pa.Array:
        memory: dict[str, str] = {}
        return pa.array([None if (v := s.as_py()) is None else [memory.setdefault(t, stem(t)) for t in v] for s in x], pa.list_(pa.string()))

    return of(c)


#: Runs of letters, marks and digits of any script.
WORD = re.compile(r"[^\W_]+")


def analyse(text: str) -> list[str]:
    """The terms of a text: words of any script in lower case, without accents, stemmed; no stop words go."""
    return [porter(w) for w in WORD.findall(plain_letters(text))]


def analysed(c: Column) -> Column:
    """`analyse` as a column of arrays, a batch at a time; a worker remembers the words of a batch."""
    ship(SparkSession.active())

    @F.arrow_udf("array<string>")
    def of(x: pa.Array) -> pa.Array:
        memory: dict[str, str] = {}

        def one(text: str) -> list[str]:
            return [memory.get(w) or memory.setdefault(w, porter(w)) for w in WORD.findall(plain_letters(text))]

        return pa.array([None if (v := s.as_py()) is None else one(v) for s in x], pa.list_(pa.string()))

    return of(c)


def spoken_alike(c: Column) -> Column:
    """Text of images with look-alikes written one way: `rn` as m, 0 as o, and 1 as l, the first of each list of LOOK_ALIKES."""
    out = F.lower(c)
    for written in sorted(LOOK_ALIKES, key=lambda w: (-len(w), w)):
        out = F.replace(out, F.lit(written), F.lit(LOOK_ALIKES[written][0]))
    return out


def alike_variants(term: str) -> list[str]:
    """All readings of a term of an image's text under LOOK_ALIKES, the term itself first."""
    out = [term]
    for written, readings in LOOK_ALIKES.items():
        out += [t.replace(written, r) for t in list(out) if written in t for r in readings]
    return list(dict.fromkeys(out))


def snippet(c: Column, needle: str, around: int = 40) -> Column:
    """What stands around the first case-insensitive hit, with ellipses where text is cut; null without a hit."""
    at = F.instr(F.lower(c), needle.lower())
    first = F.greatest(at - around, F.lit(1))
    last = F.least(at + len(needle) - 1 + around, F.length(c))
    body = F.substr(c, first, last - first + 1)
    return F.when(at > 0, F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), body, F.when(last < F.length(c), F.lit("...")).otherwise(F.lit(""))))


def highlight(c: Column, words: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every case-insensitive occurrence of the words, as they are written, between marks."""
    import re

    pattern = "(?i)(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"
    return F.regexp_replace(c, pattern, f"{before}$1{after}")


def fragments(c: Column, words: list[str], size: int = 200, most: int = 3) -> Column:
    """Up to `most` pieces of `size` characters that hold one of the words, highlighted."""
    import re

    pattern = "(?i)(" + "|".join(re.escape(w) for w in words) + ")"
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(c) - 1, F.lit(0)) / size).cast("int")), lambda i: F.substr(c, i * size + 1, F.lit(size)))
    return F.transform(F.slice(F.filter(pieces, lambda p: p.rlike(pattern)), 1, most), lambda p: highlight(p, words))


def truncated(c: Column, n: int) -> Column:
    """At most n characters; an ellipsis marks a cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def numbered_lines(c: Column) -> Column:
    """The lines of a list, without blank ones and those that start with `#`."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def titled(c: Column) -> Column:
    """(title, body) of `**Title** body`; without a title the whole is the body."""
    pattern = r"(?s)^\s*\*\*(.+?)\*\*\s*(.*)$"
    return F.struct(
        F.coalesce(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit("Thinking")).alias("title"),
        F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 2)).otherwise(c).alias("body"),
    )


def transcript(c: Column) -> Column:
    """A speech recogniser's answer without its `language X<asr_text>` head."""
    return F.trim(F.regexp_replace(c, r"^language\s+\S+?\s*<asr_text>", ""))


def unfenced_json(c: Column) -> Column:
    """The text of a JSON answer without code fences around it."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9-]", "-")


def without_image_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)|<image>|</image>", "")
