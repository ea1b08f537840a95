"""Sample quality control and classification as ordered predicates (the first that holds wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that place a country, in the order in which they are tried.
OCEANIA = (
    "australia", "new guinea", "papua", "vanuatu", "solomon", "fiji",
    "tonga", "samoa", "new zealand", "guam", "micronesia", "polynesia",
    "palau", "new caledonia", "new britain", "new ireland", "bismarck",
    "tuvalu", "kiribati", "marquesas",
)
AMERICAS = (
    "united states", "usa", "canada", "mexico", "guatemala", "belize",
    "honduras", "salvador", "nicaragua", "costa rica", "panama",
    "colombia", "venezuela", "ecuador", "peru", "brazil", "bolivia",
    "chile", "argentina", "uruguay", "paraguay", "cuba", "dominican",
    "puerto rico", "bahamas", "greenland", "haiti", "jamaica",
)
AFRICA = (
    "morocco", "algeria", "tunisia", "libya", "egypt", "sudan",
    "ethiopia", "eritrea", "somalia", "djibouti", "kenya", "tanzania",
    "uganda", "rwanda", "burundi", "malawi", "mozambique", "zambia",
    "zimbabwe", "botswana", "namibia", "south africa", "lesotho",
    "angola", "congo", "cameroon", "nigeria", "niger", "chad", "mali",
    "mauritania", "senegal", "gambia", "guinea-bissau", "ghana",
    "ivory", "cote d", "burkina", "benin", "togo", "sierra leone",
    "liberia", "gabon", "central african", "swahili",
)
# Parts of group names of references, archaics and other species.
NOT_TESTED = ("neanderthal", "denisova", "chimp", "gorilla", "ancestor", "href", "hg19ref", "_mix")


def first_of(cases: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def any_of(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def continent(country: Column, lat: Column, lon: Column) -> Column:
    low = F.lower(country)
    return first_of(
        [
            (any_of(low, OCEANIA), "Oceania"),
            (any_of(low, AMERICAS), "Americas"),
            (any_of(low, AFRICA), "Africa"),
            (lon.isNotNull() & lat.isNotNull() & (lon <= -28), "Americas"),
            (lon.isNotNull() & lat.isNotNull() & (lat <= -10) & (lon >= 100), "Oceania"),
            (lon.isNotNull() & lat.isNotNull(), "Eurasia"),
            (country.isNotNull() & (country != ""), "Eurasia"),
        ],
        "Unknown",
    )


def flags(cases: Sequence[tuple[Column, str]]) -> Column:
    """The names whose conditions hold, as an array."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in cases]))


def half_open(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin [lo, hi) that holds x, else NULL."""
    return first_of([((x >= lo) & (x < hi), i) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def right_closed(x: Column, width: float) -> Column:
    """Number of the bin (lo, hi] of this width."""
    return F.ceil(x / width).cast("bigint")


def numeric(text: Column) -> Column:
    """Number in a metadata field: blanks and the usual marks of missing values are NULL, thousands commas go."""
    t = F.trim(text)
    return F.when(~t.isin("", "..", "...", "n/a", "na", "NA"), F.regexp_replace(t, ",", "").try_cast("double"))


def data_type(sample: Column) -> Column:
    """Upper-cased suffix after the last dot of a sample id, NA without."""
    return F.coalesce(F.upper(F.nullif(F.regexp_extract(sample, r"\.([A-Za-z]+)$", 1), F.lit(""))), F.lit("NA"))


def macro_region(lat: Column, lon: Column) -> Column:
    """Region by coordinate bands, the first that fits. The bounds are fixed values."""
    return first_of(
        [
            (lat.isNull() | lon.isNull(), "Unknown"),
            ((lon >= 95) & (lat < 12), "Island SE Asia / Oceania"),
            ((lat < 12) & lon.between(-20, 52), "Africa"),
            ((lat >= 55) & (lon >= 55), "Siberia"),
            (lon.between(-12, 45) & lat.between(36, 72), "Europe"),
            ((lon > 45) & (lon <= 62) & lat.between(33, 60), "Caucasus / W. Central Asia"),
            ((lon >= 20) & (lon < 63) & (lat >= 12) & (lat < 42), "Near East / Anatolia"),
            (lon.between(62, 92) & (lat >= 5) & (lat < 38), "South Asia"),
            ((lon >= 62) & (lon < 100) & (lat >= 38) & (lat < 55), "Central Asia / Steppe"),
            ((lon >= 92) & (lat >= 18) & (lat < 60), "East Asia"),
        ],
        "Other Eurasia",
    )


def is_modern(sample: Column, date_bp: Column) -> Column:
    return (date_bp.isNotNull() & (date_bp < 50)) | (date_bp.isNull() & sample.endswith(".HO"))


def gate(genotyped: Column, group: Column, modern: Column, where: Column, assessment: Column, nsnp: Column, floor: int, everywhere: bool = False) -> Column:
    """Reason of the first failing gate, NULL for samples that pass; everywhere: age and continent don't matter."""
    low = F.lower(F.coalesce(group, F.lit("")))
    quality = F.lower(F.coalesce(assessment, F.lit("")))
    scoped = [] if everywhere else [(modern, "present_day"), (where != "Eurasia", F.concat(F.lit("non_eurasian:"), where))]
    return first_of(
        [
            (~genotyped, "not_in_geno"),
            (any_of(low, NOT_TESTED), "reference_or_archaic"),
            *scoped,
            (quality.contains("critical") | quality.contains("fail"), F.concat(F.lit("qc_assessment:"), F.substring(F.trim(assessment), 1, 20))),
            (F.coalesce(nsnp < floor, F.lit(True)), F.concat(F.lit("low_snps:"), F.coalesce(nsnp.cast("bigint").cast("string"), F.lit("")))),
        ]
    )


def lower_bound(interval: Column) -> Column:
    """The number after the first bracket of an interval in text, NULL without one."""
    return F.regexp_extract(F.coalesce(interval, F.lit("")), r"\[([0-9.]+)", 1).try_cast("double")
