"""Text expressions.  All of them are Catalyst columns; none needs Python at run time."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import rules

# Every character a Unicode-aware \s stands for, for use inside [...].
WS = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters one by one.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WS_NOT_SPACE = WS.replace(r"\s", r"\t\n\f\r")
# A run that is not already a single space.
_WS_RUN = f" [{WS}]+|[{_WS_NOT_SPACE}][{WS}]*"
# Characters that normalisation turns into spaces.
SPECIAL = r"[^\p{L}\p{N}_\s\-.,:;()$%#]"
WORD = r"\p{L}\p{N}_"


def trim_white(c: Column) -> Column:
    """Remove white space of any kind from both ends; `c` is evaluated once."""
    return F.trim(c, F.lit(WS_CHARS))


def strip(c: Column) -> Column:
    """`trim_white` for a column or variable.  Trimming goes through the whole string, so only one that has white space
    at an end is trimmed; as `c` is looked at before, one that has to be worked out is better trimmed at once."""
    def white(end: Column) -> Column:
        return F.lit(WS_CHARS).contains(end)
    return F.when(white(F.left(c, F.lit(1))) | white(F.right(c, F.lit(1))), trim_white(c)).otherwise(c)


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, _WS_RUN, " ")


def normalize_text(c: Column) -> Column:
    """Lower case, single spaces, special characters blanked, trimmed."""
    return F.trim(F.regexp_replace(collapse(F.lower(c)), SPECIAL, " "))


def ml_preprocess(c: Column) -> Column:
    """Normalisation for the statistical models: whole numbers become NUMBER and
    words of one or two characters go."""
    text = F.regexp_replace(collapse(F.lower(c)), SPECIAL, " ")
    text = F.regexp_replace(text, rf"(?<![{WORD}])\p{{Nd}}+(?![{WORD}])", "NUMBER")
    return F.array_join(F.filter(F.split(text, " +"), lambda w: F.length(w) > 2), " ")


def normalize_name(c: Column) -> Column:
    """Field name used for matching: trimmed, single spaces, lower case."""
    return F.lower(collapse(strip(c)))


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def element_type(line: Column, stripped: Column) -> Column:
    """Kind of a text line; the first rule that holds wins."""
    header = stripped.rlike(f"^[A-Z{WS}]+$") & (F.length(stripped) > 3)
    return (F.when(header, "header")
            .when(contains_any(F.lower(stripped), rules.FINANCIAL_WORDS), "financial")
            .when(line.rlike(rules.CURRENCY_PATTERN), "currency")
            .when(line.rlike(rules.SHORT_DATE_PATTERN), "date")
            .otherwise("text"))


def confidence_band(c: Column) -> Column:
    out = None
    for bound, name in rules.BANDS:
        out = F.when(c >= bound, name) if out is None else out.when(c >= bound, name)
    return out.otherwise(rules.LOWEST_BAND)


def money_label(c: Column) -> Column:
    """$1234.50 for an amount read from text; one too large for two exact decimals keeps its plain form."""
    return F.concat(F.lit("$"), F.coalesce(c.try_cast("decimal(38,2)").cast("string"), c.cast("string")))


def parse_number(c: Column) -> Column:
    """Number in a string, commas ignored; NULL when it is none."""
    s = trim_white(F.replace(c, F.lit(","), F.lit("")))
    plain = s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | s.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
    return F.when(plain, s.try_cast("double"))


def _ascii_table() -> tuple[str, str]:
    """Letters and digits whose compatibility decomposition holds exactly one ASCII character."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if unicodedata.category(ch)[0] not in "LN":
            continue
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            src.append(ch)
            dst.append(plain)
    return "".join(src), "".join(dst)


ASCII_FROM, ASCII_TO = _ascii_table()


def strip_accents(c: Column) -> Column:
    """Accented letters become plain ones, anything else outside ASCII goes."""
    return F.regexp_replace(
        F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, ASCII_FROM, ASCII_TO)).otherwise(c),
        r"[^\x00-\x7F]", "")


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Word tokens of at least two characters, lower case, without stop words."""
    words = F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(r"[a-z0-9_]{2,}"), F.lit(0))
    stop = stop_words if stop_words is not None else rules.STOP_WORDS
    return F.filter(words, lambda w: ~w.isin(stop))


def _window(toks: Column, n: int):
    return lambda i: F.array_join(F.slice(toks, i, n), " ")


def ngrams(toks: str, n_max: int) -> Column:
    """All n-grams of 1..n_max tokens of a token column, with repetitions.  Takes
    a column name: an expression would be evaluated again for every n-gram."""
    toks = F.col(toks)
    parts = [toks]
    for n in range(2, n_max + 1):
        idx = F.sequence(F.lit(1), F.size(toks) - (n - 1))
        grams = F.transform(idx, _window(toks, n))
        parts.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)
