"""Header operators: canonical names, aliases, repeated columns, required columns, format detection."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

INTERNAL, D1, UNKNOWN = "FORMATO_INTERNO", "DATASET_D1", "NO_RECONOCIDO"


def raw_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().upper())


def template_name(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.strip().lower()) if not unicodedata.combining(c))
    return re.sub("_+", "_", re.sub(r"[ \-./\\]", "_", plain)).strip("_")


def raw_header(df: DataFrame) -> DataFrame:
    """Canonical raw names; an alias applies only where its target is absent."""
    df = df.toDF(*map(raw_name, df.columns))
    return df.withColumnsRenamed({a: b for a, b in S.RAW_ALIASES.items() if a in df.columns and b not in df.columns})


def template_header(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Canonical template names with aliases; of columns that then coincide the first stays, the others give a warning."""
    names = [S.TEMPLATE_ALIASES.get(n, n) for n in map(template_name, df.columns)]
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    warnings = [f"Columna duplicada tras normalización omitida: {n}" for i, n in enumerate(names) if first[n] != i]
    kept = sorted(first.values())
    placed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return placed.select(*[placed[f"c{i}"].alias(names[i]) for i in kept]), warnings


def require(df: DataFrame, names: Iterable[str], what: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: faltan columnas: {', '.join(missing)}")
    return df


def detect_format(names: Iterable[str]) -> str:
    """The upload's format by its header."""
    names = list(names)
    template = {S.TEMPLATE_ALIASES.get(n, n) for n in map(template_name, names)}
    raw = {S.RAW_ALIASES.get(n, n) for n in map(raw_name, names)}
    if set(S.TEMPLATE_REQUIRED) <= template:
        return INTERNAL
    return D1 if set(S.RAW_REQUIRED) <= raw else UNKNOWN


def format_of(header: Column, separator: Column) -> Column:
    """detect_format over header lines, as an expression. Names are taken apart at the separator; accents as template headers have them."""
    names = F.transform(F.split(header, separator), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    upper = F.transform(names, lambda x: F.regexp_replace(F.upper(x), r"\s+", "_"))
    plain = lambda x: F.translate(F.lower(x), "áéíóúüñ", "aeiouun")
    lower = F.transform(names, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(plain(x), r"[ \-./\\]", "_"), "_+", "_"), "^_|_$", ""))
    known = lambda found, aliases: F.transform(found, lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for pair in aliases.items() for y in pair]), x), x))
    has = lambda found, wanted: F.size(F.array_except(F.array(*map(F.lit, wanted)), found)) == 0
    return F.when(has(known(lower, S.TEMPLATE_ALIASES), S.TEMPLATE_REQUIRED), INTERNAL).when(has(known(upper, S.RAW_ALIASES), S.RAW_REQUIRED), D1).otherwise(UNKNOWN)
