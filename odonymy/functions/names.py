"""Name normalization and name patterns as Column expressions, without any UDF.

Folding (compatibility decomposition, marks dropped, case folded) is free of context, so the
driver derives a character table from ``unicodedata`` once and the executors apply it with
``translate`` and, in rows with characters that fold to several, with ``replace``. Names of any
length are worked on as one string, without a list of their tokens.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading words that name a kind of street, folded; Italian, then French.
STREET_TYPES = (
    "asse", "autostrada", "borgata", "borgo", "calle", "cascina", "cavalcavia", "ciclabile", "ciclopedonale", "ciclovia",
    "circonvallazione", "contra", "contrada", "corso", "corte", "cortile", "degli", "dei", "del", "della", "delle", "di",
    "discesa", "frazione", "galleria", "largo", "localita", "lungo", "lungolago", "lungomare", "mulattiera", "parco",
    "passaggio", "passeggiata", "per", "percorso", "piazza", "piazzale", "piazzetta", "pista", "ponte", "raccordo", "ronco",
    "rotatoria", "rotonda", "salita", "sentiero", "sp", "ss", "strada", "stradello", "streda", "stradone", "svincolo",
    "tangenziale", "traversa", "variante", "via", "viadotto", "viale", "vico", "vicolo",
    "allee", "avenue", "boulevard", "chemin", "hameau", "impasse", "localite", "montee", "place", "quai", "ru", "route",
    "rue", "ruelle",
)
#: Letters and numbers of any script; the four last ones fold to Latin but are newer than Java's tables.
_OTHER = r"[^\p{L}\p{N}\x{A7F2}-\x{A7F4}\x{107A5}]+"
_TOKEN = _OTHER.replace("[^", "[")
#: From here on a character may be one of those that fold to several; below, they are named one by one.
_FAR = "\u0250"


def folded(text: str) -> str:
    """What one piece of text folds to (driver side; the executors use ``fold``)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters folding to one of [a-z0-9], what they fold to, and those folding to several characters."""
    source, target, longer = [], [], []
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if not c.isalnum():
            continue
        to = folded(c)
        if to == c:
            continue
        kept = re.sub("[^a-z0-9]", "", to)
        if len(to) == 1 and kept:
            source.append(c)
            target.append(to)
        elif kept:
            longer.append((c, to))
    return "".join(source), "".join(target), tuple(longer)


def fold(text: Column) -> Column:
    """Lower-case text with diacritics folded, as far as it gives [a-z0-9]; other characters stay or go."""
    source, target, longer = _tables()
    marks = F.replace(F.translate(text, source, target), F.lit("ß"), F.lit("ss"))
    # What else folds to several characters is hardly ever there: only rows that hold some are gone through.
    rare = [(c, to) for c, to in longer if c != "ß"]
    low = "".join(c for c, _ in rare if c < _FAR)
    there = text.rlike(f"[{low}\\x{{{ord(_FAR):X}}}-\\x{{10FFFF}}]") & (F.translate(text, "".join(c for c, _ in rare), "") != text)
    table = F.array(*(F.array(F.lit(c), F.lit(to)) for c, to in rare))
    return F.when(there, F.aggregate(table, marks, lambda a, x: F.replace(a, x[0], x[1]))).otherwise(marks)


def _token_lines(name: Column) -> Column:
    """Runs of letters and numbers, folded, one to a line."""
    # Folding never joins or parts tokens of one script, so the name is folded once; line feeds keep tokens apart.
    return fold(F.btrim(F.regexp_replace(name, _OTHER, "\n"), F.lit("\n")))


def normalize_name(name: Column) -> Column:
    """Grouping key: leading street-type words dropped (all kept if nothing else is there), the rest folded and joined."""
    lines = _token_lines(name)
    # The first line that is no type word; a token counts by what it folds to before other scripts' characters are dropped.
    at = F.regexp_instr(lines, F.lit(rf"(?<![^\n])(?!(?:{'|'.join(STREET_TYPES)})(?![^\n]))[^\n]"))
    return F.regexp_replace(F.substr(lines, F.greatest(at, F.lit(1))), "[^a-z0-9]+", "")


def first_word(name: Column) -> Column:
    """First token with a letter or digit left after folding; null if there is none."""
    # Nearly always that is the first token; only where nothing is left of it the others are looked at.
    plain = F.regexp_replace(fold(F.regexp_extract(name, _TOKEN, 0)), "[^a-z0-9]+", "")
    later = F.regexp_extract(F.regexp_replace(_token_lines(name), r"[^a-z0-9\n]+", ""), "[a-z0-9]+", 0)
    return F.when(plain != "", plain).otherwise(F.nullif(later, F.lit("")))


def is_street_type(word: Column) -> Column:
    return word.isin(*STREET_TYPES)


def like_ascii(text: Column, pattern: str) -> Column:
    """LIKE that ignores case for A-Z only and knows no escape character."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    small = pattern.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(text, upper, lower).like(small)


def matches(text: Column, includes: list[str], excludes: list[str] | tuple[str, ...] = ()) -> Column:
    """Any include pattern and no exclude pattern."""
    if not includes:
        raise ValueError("at least one include pattern is needed")
    any_of = functools.reduce(lambda a, b: a | b, (like_ascii(text, p) for p in includes))
    return functools.reduce(lambda a, p: a & ~like_ascii(text, p), excludes, any_of)
