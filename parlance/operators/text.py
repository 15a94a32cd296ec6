"""Text normalisers as column functions. ``(?U)`` makes Java's classes Unicode-aware."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DASHES = "[-‐-―_/]+"
APOSTROPHES = "‘’`´"
EDGES_OF_OUTPUT = ".,;:!?\"'()[]{}<>-"
EDGES_OF_TOKENS = '.,;:!?"()[]'
ENDS_OF_NUMBERS = ".,;:!?"
CONTRACTIONS = {
    "can't": "cannot",
    "won't": "will not",
    "shan't": "shall not",
    "ain't": "is not",
    "let's": "let us",
    "i'm": "i am",
    "gonna": "going to",
    "wanna": "want to",
    "gotta": "got to",
}
SUFFIXES = (("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"))
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((10**9, "billion"), (10**6, "million"), (10**3, "thousand"), (1, ""))
# end of fixed values

#: A word's characters: letters, numbers of any kind, the underscore; not combining marks.
WORD = r"[\p{L}\p{N}_]"


def split_words(text: Column) -> Column:
    """Words between white space, no empty ones; the information separators U+001C to U+001F are white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _one_of(chars: str) -> str:
    return "[" + "".join(f"\\{c}" for c in chars) + "]"


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _below_thousand(n: int) -> str:
    """Words of 1 to 999; nothing for 0."""
    hundreds = [f"{ONES[n // 100]} hundred"] if n >= 100 else []
    rest = n % 100
    small = [ONES[rest]] if 0 < rest < 20 else [TENS[rest // 10 - 2], *([ONES[rest % 10]] if rest % 10 else [])] if rest else []
    return " ".join(hundreds + small)


def integer_words(n: Column) -> Column:
    """English words of whole numbers from 0 to 10^12 - 1, without "and"; null for others. The words of each group
    of three digits stand in one literal array."""
    groups = F.array(*[F.lit(_below_thousand(i)) for i in range(1000)])

    def words(n: Column) -> Column:
        group = lambda scale: (F.floor(n / scale) % 1000).cast("int")
        parts = [F.when(group(scale) > 0, F.concat(F.get(groups, group(scale)), F.lit(f" {name}" if name else ""))) for scale, name in SCALES]
        return F.when((n >= 0) & (n < 10**12), F.when(n == 0, F.lit(ONES[0])).otherwise(F.concat_ws(" ", *parts)))

    return _let(n, words)


def number_words(token: Column) -> Column:
    """Words of a plain number ("1,234", "-3.5"); null for any other token."""
    ones = F.array(*map(F.lit, ONES))
    part = lambda i: F.regexp_extract(token, r"^(-?)(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?$", i)

    def words(p: Column) -> Column:
        fraction = F.array_join(F.transform(F.split(p["fraction"], ""), lambda d: F.get(ones, d.cast("int"))), " ")
        after = F.when(p["fraction"] != "", F.concat(F.lit(" point "), fraction)).otherwise(F.lit(""))
        value = F.when(F.length(p["whole"]) <= 12, F.when(p["whole"] == "", F.lit("0")).otherwise(p["whole"]).cast("long"))
        return F.when(p["fits"], F.concat(p["sign"], integer_words(value), after))

    whole = F.ltrim(F.regexp_replace(part(2), ",", ""), F.lit("0"))
    sign = F.when(part(1) != "", F.lit("minus ")).otherwise(F.lit(""))
    return _let(F.struct((part(2) != "").alias("fits"), sign.alias("sign"), whole.alias("whole"), part(3).alias("fraction")), words)


def expand_contractions(text: Column) -> Column:
    """Whole tokens only, between the punctuation at their edges."""
    edge = _one_of(EDGES_OF_TOKENS)

    def one(token: Column) -> Column:
        core = F.regexp_replace(token, f"^{edge}+|{edge}+$", "")
        lead = F.regexp_extract(token, f"^{edge}*", 0)
        trail = F.when(core == "", F.lit("")).otherwise(F.regexp_extract(token, f"{edge}*$", 0))
        found = reduce(lambda case, x: case.when(core == x[0], F.lit(x[1])), CONTRACTIONS.items(), F)
        for suffix, words in SUFFIXES:
            found = found.when(core.endswith(suffix) & (F.length(core) > len(suffix)), F.concat(F.left(core, F.length(core) - len(suffix)), F.lit(words)))
        return F.coalesce(F.concat(lead, found, trail), token)

    return F.array_join(F.transform(split_words(F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))), one), " ")


def numbers_to_words(text: Column) -> Column:
    end = _one_of(ENDS_OF_NUMBERS)

    def one(token: Column) -> Column:
        core = F.regexp_replace(token, f"{end}+$", "")
        return F.coalesce(F.concat(number_words(core), F.substring(token, F.length(core) + 1, F.length(token))), token)

    return F.array_join(F.transform(split_words(text), one), " ")


def normalise(text: Column, lowercase: bool = True, strip_punctuation: bool = True, collapse_whitespace: bool = True, contractions: bool = False, numbers: bool = False) -> Column:
    """Lower case, contractions and numbers as words if asked, dashes and slashes to spaces, words
    and inner apostrophes kept, single spaces."""
    x = F.lower(text) if lowercase else text
    x = expand_contractions(x) if contractions else x
    x = numbers_to_words(x) if numbers else x
    if strip_punctuation:
        x = F.regexp_replace(x, DASHES, " ")
        x = F.translate(x, APOSTROPHES, "'" * len(APOSTROPHES))
        x = F.regexp_replace(x, rf"(?U)(?:(?!{WORD})[^\s'])", "")
        x = F.regexp_replace(x, f"(?<!{WORD})'|'(?!{WORD})", "")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) if collapse_whitespace else x


def corpus_words(text: Column, **options: bool) -> Column:
    """Tokens of a corpus' text: anything but word characters and apostrophes divides."""
    return split_words(normalise(F.regexp_replace(text, rf"(?U)(?:(?!{WORD})[^'])+", " "), **options))


def letters_only(text: Column) -> Column:
    """Lower-cased tokens of a-z only."""
    return F.filter(F.transform(split_words(F.lower(text)), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: w != "")


def output_tokens(text: Column) -> Column:
    """Lower-cased words without punctuation at their edges; empty ones go."""
    edge = _one_of(EDGES_OF_OUTPUT)
    bare = F.transform(split_words(F.lower(text)), lambda w: F.regexp_replace(w, f"^{edge}+|{edge}+$", ""))
    return F.filter(bare, lambda w: w != "")


def time_text(seconds: Column) -> Column:
    """Six decimals without trailing zeros, one decimal at least."""
    short = F.regexp_replace(F.format_string("%.6f", seconds), "0+$", "")
    return F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)


def seed_number(*parts: Column) -> Column:
    """The first eight bytes of the sha256 of the parts, joined by "|", as a little-endian whole
    number: text, as it may pass a long."""
    digest = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    turned = F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, 10)
