"""Text: literals that mean null, tokens, slugs, folded accents, fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Texts that stand for an absent value, in reports, in plans and in migrations.
NULL_REPORT = ("null", "none", "nil", "undefined", "nan", "~", "n/a", "na", "[]", "{}", "''", '""', "")
NULL_PLAN = ("", "null", "none", "~", "-", "0")
#: Accented letters that search ignores, and their plain forms, place by place.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def clean_null(value: Column, literals: tuple[str, ...] = NULL_REPORT) -> Column:
    """Null where the trimmed, unquoted, lower-cased text is one of the literals."""
    bare = F.lower(F.trim(value))
    return F.when(~(bare.isin(*literals) | F.regexp_replace(bare, r"^[\"']+|[\"']+$", "").isin(*literals)), value)


def clean_nested(value: Column, kind: DataType, literals: tuple[str, ...] = NULL_REPORT) -> Column:
    """clean_null for every text inside a value of this type: in arrays, map values and structs, at any depth."""
    if isinstance(kind, StringType):
        return clean_null(value, literals)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: clean_nested(x, kind.elementType, literals))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: clean_nested(v, kind.valueType, literals))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[clean_nested(value[f.name], f.dataType, literals).alias(f.name) for f in kind.fields]))
    return value


def token(value: Column) -> Column:
    """Blanks collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def word_count(text: Column) -> Column:
    """Runs of non-blank characters; null is 0 words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def chunk_word_count(chunks: Column) -> Column:
    """Words of an array of text chunks, counted chunk by chunk."""
    return F.aggregate(chunks, F.lit(0), lambda n, c: n + F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)))


def fold_accents(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def ids_in_cell(cell: Column) -> Column:
    """Whole numbers of a cell, whatever separates them."""
    return F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))


def ids_with_ranges(cell: Column) -> Column:
    """Whole numbers of a cell; "35-38" is 35, 36, 37, 38."""
    parts = F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"(\d+(?:-\d+)?)"), 1)
    return F.flatten(F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))))


#: Where a whole unit of sense ends, and the marks that are not kept at its ends.
UNIT_ENDS = (" : ", " — ", " – ", ". ", " ; ")
UNIT_MARKS = " .;:—–"


def first_sentence(text: Column, longest: int = 170) -> Column:
    """A text's first whole unit of sense, runs of blanks as one: up to the earliest of UNIT_ENDS that stands at most `longest`
    characters in, without the mark; the whole text where none does. Null gives an empty text."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    ends = F.array(*[F.locate(e, plain) - 1 for e in UNIT_ENDS])
    first = F.array_min(F.filter(ends, lambda i: (i > 0) & (i <= longest)))
    return F.when(first.isNull(), plain).otherwise(F.btrim(F.substring(plain, F.lit(1), first), F.lit(UNIT_MARKS)))


def status_code(cell: Column) -> Column:
    """The two-letter code in backticks."""
    return F.nullif(F.regexp_extract(cell, r"`([A-Z]{2})`", 1), F.lit(""))


def fingerprint(content: Column, digits: int = 12) -> Column:
    """A SHA-256 prefix that does not depend on the line ends."""
    return F.substring(F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256), 1, digits)


@F.pandas_udf(StringType())
def _ascii(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def slug(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, joined by hyphens; apostrophes part words."""
    plain = _ascii(F.translate(text, "'’", "  "))
    return F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


#: What proves that a file was read (a quotation, or a count of what it holds), and what says that there is none.
READ = r"«[^»]{3,}»|`[^`]{3,}`|\b\d+\s*(?:URL|lien|entr[ée]e|section|ligne|item|rubrique)s?\b"
ABSENT = r"\b(absent|introuvable|n'existe pas|404|non servi|aucun llms)\b"


def read_evidence(text: Column) -> Column:
    """Whether a finding quotes a file or counts what it holds."""
    return text.rlike(f"(?iU){READ}")


def says_absent(text: Column) -> Column:
    return text.rlike(f"(?iU){ABSENT}")


def enumeration(text: Column, least: int = 3) -> Column:
    """The trimmed items of a list parted by semicolons, or null if there are fewer than `least`."""
    items = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) >= least, items)


def enumeration_rows(text: Column) -> Column:
    """A semicolon list as rows (label, value): what stands before and after an item's first colon; null for no list."""
    pair = lambda i: F.struct(F.trim(F.split(i, ":", 2)[0]).alias("label"), F.nullif(F.trim(F.regexp_extract(i, r"^[^:]*:(.*)$", 1)), F.lit("")).alias("value"))
    return F.transform(enumeration(text), pair)


def markdown_tables(text: Column) -> Column:
    """The body rows of the pipe tables of a text, each an array of trimmed cells; rulers are left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def markdown_to_prose(text: Column) -> Column:
    """Links to their words, and no emphasis, code marks, headings or bullets."""
    out = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(?:#{1,6}\s+|[-*+]\s+|>\s?)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\*\*|__|`", ""), r"\s+", " "))
