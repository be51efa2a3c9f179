"""Expressions with the missing-value rules that all operators follow: NaN counts as missing, divisions by zero give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: list[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def numeric_columns(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    """Columns of numeric or boolean type, without those that have another role."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType | T.BooleanType) and f.name not in leave]


def number(c: Column | str) -> Column:
    """As double; what can't be read as one, and NaN, is null."""
    c = F.col(c) if isinstance(c, str) else c
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(c: Column | str) -> Column:
    """number() without infinities."""
    value = number(c)
    return F.when(F.abs(value) != F.lit(float("inf")), value)


def over(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where either is constant."""
    return over(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each row of df and column, values as double without NaN."""
    return df.select(*ids, *[number(c).alias(c) for c in columns]).unpivot(ids, columns, name, value)


def stem(path: Column) -> Column:
    """File name without folders and without its suffix; .nii.gz is one suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(\.nii\.gz|\.[^.]+)$", "")


def tidy_name(name: Column, upper: dict[str, str] | None = None) -> Column:
    """Words between underscores without other signs; known abbreviations in capitals, words with a capital after their first sign kept, others with a capital in front."""
    upper = ABBREVIATIONS if upper is None else upper
    known = F.create_map(*[F.lit(x) for pair in upper.items() for x in pair])

    def word(w: Column) -> Column:
        w = F.regexp_replace(w, "[^A-Za-z0-9]", "")
        kept = F.substr(w, F.lit(2)).rlike("[A-Z]")
        return F.coalesce(known[F.lower(w)], F.when(kept, w), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))

    return F.array_join(F.filter(F.transform(F.split(name, "_"), word), lambda w: w != ""), "_")


# Abbreviations that feature names write in capitals.
ABBREVIATIONS = {"glcm": "GLCM", "gldm": "GLDM", "glrlm": "GLRLM", "glszm": "GLSZM", "ngtdm": "NGTDM", "id": "ID", "idn": "IDN", "idm": "IDM", "ids": "IDS"}


def safe_filename(name: Column, replacement: str = "_", most: int = 255) -> Column:
    """Reserved signs replaced, control characters dropped, cut to a length with the suffix kept."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', replacement), r"[\x00-\x1f]", "")
    suffix = F.regexp_extract(clean, r"(\.[^.]*)$", 1)
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most) - F.length(suffix)), suffix)).otherwise(clean)


def to_unit_scale(value: Column, low: float = -1000.0, high: float = 3000.0) -> Column:
    """CT numbers as 0 to 1, clipped."""
    return (clipped(value, low, high) - low) / (high - low)


def from_unit_scale(value: Column, low: float = -1000.0, high: float = 3000.0) -> Column:
    return value * (high - low) + low
