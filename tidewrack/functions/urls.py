"""URLs: normal form, parts, resolution of relative references."""

from __future__ import annotations

from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The first pattern that a path meets names its page type.
TEMPLATES = (
    (r"^/?$", "accueil"),
    (r"/(blog|actualite|article|news)/", "article"),
    (r"/(categorie|category|rubrique)/", "categorie"),
    (r"/(produit|product|gite|chambre|offre)/", "produit"),
    (r"/(contact|mentions|cgv|politique|legal)", "service"),
    (r"/(panier|checkout|commande|reservation)", "transactionnel"),
)
OTHER_TEMPLATE = "page"


def normalise(url: Column) -> Column:
    """No fragment, an empty path is "/", and one trailing slash goes from a longer path; query and host case stay."""
    bare = F.regexp_replace(url, r"#.*$", "")
    form = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)(\?.*)?$"
    own = F.coalesce(F.nullif(F.regexp_extract(bare, form, 2), F.lit("")), F.lit("/"))
    own = F.when((F.length(own) > 1) & own.endswith("/"), F.substring(own, F.lit(1), F.length(own) - 1)).otherwise(own)
    return F.concat(F.regexp_extract(bare, form, 1), own, F.regexp_extract(bare, form, 3))


def path(url: Column) -> Column:
    """The path of a URL, "/" where it has none; a broken escape does not hide it."""
    found = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("/"))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def template(path_: Column) -> Column:
    """The page type of a path."""
    first, *rest = TEMPLATES
    out = F.when(path_.rlike(first[0]), first[1])
    for pattern, name in rest:
        out = out.when(path_.rlike(pattern), name)
    return out.otherwise(OTHER_TEMPLATE)


def file_safe(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^https?://", ""), r"[^A-Za-z0-9._-]+", "-")


@F.pandas_udf(StringType())
def _unquote(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unquote(v))


def percent_decode(text: Column) -> Column:
    """A plus sign stays, and a broken escape stays as it is."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.coalesce(decoded, _unquote(text))


@F.pandas_udf(StringType())
def _join(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b, r):
        if b is None or r is None:
            return None
        try:
            return urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)])


def resolve(base: Column, ref: Column) -> Column:
    """An absolute URL from a reference. Absolute and root-relative references need no Python; others do."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    scheme = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    simple = ~ref.rlike(r"(^|/)\.\.?(/|$|\?|#)")
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & simple, ref)
        .when(ref.startswith("//") & simple, F.concat(scheme, ref))
        .when(ref.startswith("/") & simple, F.concat(root, ref))
        .otherwise(_join(base, ref))
    )
