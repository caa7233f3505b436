"""Scalar column expressions: names, identifiers, levels, missing values and rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType

# Cut-points and names of the levels, and the trust curve.
CUTS = (0.80, 0.65, 0.50, 0.35)
CONFIDENCE = ("High", "Medium-High", "Medium", "Medium-Low", "Low")
RECOMMENDATION = ("Strongly Recommended", "Recommended", "Conditionally Recommended", "Low Priority", "Not Recommended")
TRUST_DEFAULT, TRUST_FLOOR, R_LOW, R_HIGH = 0.60, 0.30, 0.25, 0.50
FUSION_CONFIDENCE = {"high": 3.0, "medium": 2.0, "low": 1.0}


def rounded(c: Column, digits: int = 4) -> Column:
    """Half-up on the binary value; the same on every engine, unlike the engines' own round(). Values that have no such digits stay."""
    return F.when(F.abs(c) >= 1e15 / 10.0**digits, c).otherwise(F.floor(c * 10.0**digits + 0.5) / 10.0**digits)


def rounded_epsilon(c: Column, digits: int = 8) -> Column:
    """Half-up after 2^-52 is added, halves of negative values towards zero; null for what is no finite number."""
    scaled = (c + 2.0**-52) * 10.0**digits
    whole = F.floor(scaled)
    return F.when(F.abs(c) >= 1e15 / 10.0**digits, finite(c)).otherwise(finite((whole + (scaled - whole >= 0.5).cast("int")) / 10.0**digits))


def exact_mean(c: Column, digits: int = 9) -> Column:
    """The mean of values of so many digits at most, summed as whole numbers: the order of the rows doesn't matter."""
    whole = F.floor(c * 10**digits + 0.5).cast("decimal(20,0)")
    return F.sum(whole).cast("double") / F.count(c) / 10**digits


def clip01(c: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def safe_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(c.try_cast("double")), F.lit(default))


def mean_available(cols: Sequence[Column]) -> Column:
    """Mean of the values that are there; null if none is."""
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), count_available(cols))


def count_available(cols: Sequence[Column]) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def spread_available(cols: Sequence[Column]) -> Column:
    """Population standard deviation of the values that are there; null if none is."""
    mean = mean_available(cols)
    squares = sum((F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.sqrt(F.try_divide(squares, count_available(cols)))


def stepped(c: Column, names: Sequence[str]) -> Column:
    """The first name whose cut-point the value reaches, else the last."""
    out = F.when(c >= CUTS[0], names[0])
    for cut, name in zip(CUTS[1:], names[1:], strict=False):
        out = out.when(c >= cut, name)
    return out.otherwise(names[-1])


def confidence_level(c: Column) -> Column:
    return stepped(c, CONFIDENCE)


def recommendation_level(c: Column) -> Column:
    return stepped(c, RECOMMENDATION)


def alteration_status(mutation: Column, fusion: Column, high: Column) -> Column:
    return (
        F.when(mutation & fusion, "MIXED: MUTATION + FUSION")
        .when(mutation & high, "MUTATION (HIGH-IMPACT)")
        .when(mutation, "MUTATION")
        .when(fusion, "FUSION")
        .otherwise("NO ALTERATION")
    )


def feature_label(feature: Column, status: Column) -> Column:
    return F.when(status == "NO ALTERATION", feature).otherwise(F.concat(feature, F.lit(" ["), status, F.lit("]")))


def list_texts(df: DataFrame, *columns: str) -> list[Column]:
    """Columns as the text of a sheet: null and NaN are empty, the elements of a list are joined by semicolons, true and false are capitalised."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> Column:
        col, kind = F.col(f"`{c}`"), kinds[c]
        if isinstance(kind, ArrayType):
            return F.coalesce(F.array_join(col.cast("array<string>"), ";", "None"), F.lit("")).alias(c)
        if isinstance(kind, DoubleType | FloatType):
            col = F.when(~F.isnan(col), col)
        out = F.initcap(col.cast("string")) if isinstance(kind, BooleanType) else col.cast("string")
        return F.coalesce(out, F.lit("")).alias(c)

    return [text(c) for c in columns]


def positive(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False))


def first_text(cols: Sequence[Column]) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols))


def normal_context(c: Column) -> Column:
    """Lower case, ``-_/`` and runs of white space as one space; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "-_/", "   "), r"\s+", " "))


def upper_alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def lower_alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def upper_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def is_true(c: Column) -> Column:
    """true, 1, yes, y, t."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def is_truthy(c: Column) -> Column:
    """true, 1, yes, high: the flags of event tables."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "high"), F.lit(False))


def high_impact(flags: Sequence[Column], impact: Column) -> Column:
    return F.coalesce(F.upper(F.trim(impact)) == "HIGH", F.lit(False)) | sum((is_truthy(f).cast("int") for f in flags), F.lit(0)).cast("boolean")


def fusion_confidence(c: Column) -> Column:
    text = F.lower(F.trim(c))
    out = F.lit(0.0)
    for name, value in FUSION_CONFIDENCE.items():
        out = F.when(text == name, value).otherwise(out)
    return out


def log2_plus_one(c: Column, clipped: bool = True) -> Column:
    return F.when(c.isNotNull(), F.log2((F.greatest(c, F.lit(0.0)) if clipped else c) + 1.0))


def rna_trust(correlation: Column) -> Column:
    """1 from R_HIGH on, the floor below R_LOW, linear between; the default where unknown."""
    line = TRUST_FLOOR + (correlation - R_LOW) / (R_HIGH - R_LOW) * (1.0 - TRUST_FLOOR)
    return F.when(correlation.isNull(), TRUST_DEFAULT).when(correlation >= R_HIGH, 1.0).when(correlation < R_LOW, TRUST_FLOOR).otherwise(line)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def symbol_of_header(c: Column) -> Column:
    """``SYMBOL (ENSG...)`` -> SYMBOL; another header is a symbol as it is."""
    return F.coalesce(extracted(c, r"^\s*(.+?)\s*\(ENSG\d+(?:\.\d+)?\)\s*$"), F.trim(c))


def ensembl_of_header(c: Column) -> Column:
    return extracted(c, r"\((ENSG\d+)")


def symbol_in_parens(c: Column) -> Column:
    """``UNIPROT (SYMBOL)`` -> SYMBOL."""
    return F.coalesce(extracted(c, r"\(([^)]+)\)"), F.trim(c))


def symbol_in_last_parens(c: Column) -> Column:
    """``any (text) (SYMBOL)`` -> SYMBOL, only where the parentheses end the header; null elsewhere."""
    return extracted(c, r"\(([^()]+)\)\s*$")


def ensembl_base(c: Column) -> Column:
    """Without the version."""
    return F.substring_index(c, ".", 1)


def registry_id(c: Column) -> Column:
    return extracted(c, r"(CVCL_[A-Za-z0-9]+)")


def entity_xref(c: Column) -> Column:
    return extracted(c, r"(?i)depmap\s*[;=:]?\s*(ACH-\d+)")


def without_cell_line_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?i)^.*cell\s*line\s*[:=]\s*", ""))


def review_id(*parts: Column) -> Column:
    return F.concat(F.lit("V5-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)))


def blinded_key(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256)


def candidate_key(entity: Column, name: Column) -> Column:
    """The id, or ``NAME:`` with the normalised name."""
    return F.coalesce(F.upper(F.nullif(F.trim(entity), F.lit(""))), F.concat(F.lit("NAME:"), lower_alnum(name)))
