"""Column builders for names, sizes, numbers in tags and wavelengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag keys in order of preference, factors of unit names to nanometres, accepted range,
#: and the limit under which a number without unit counts as micrometres.
WAVELENGTH_KEYS = ("wavelength", "wavelengths", "central_wavelength", "centre_wavelength", "center_wavelength")
UNIT_KEYS = ("wavelength_units", "wavelength_unit")
NM_PER_UNIT = {"nm": 1.0, "nanometer": 1.0, "nanometers": 1.0, "nanometre": 1.0, "nanometres": 1.0, "um": 1000.0, "\u00b5m": 1000.0, "\u03bcm": 1000.0, "micrometer": 1000.0, "micrometers": 1000.0, "micrometre": 1000.0, "micrometres": 1000.0, "micron": 1000.0, "microns": 1000.0}
NM_RANGE = (100.0, 30_000.0)
MICROMETRES_BELOW = 100.0
DESCRIPTION = "(?i)(\\d+(?:\\.\\d+)?)\\s*(nm|nanomet(?:er|re)s?|um|\u00b5m|\u03bcm|microns?|micromet(?:er|re)s?)\\b"


def product_slug(name: Column) -> Column:
    """File stem in lower case, runs of other characters as one underscore; 'product' if nothing is left."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "product").otherwise(slug)


def format_bytes(n: Column) -> Column:
    """Binary units; whole bytes, else one decimal."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / F.lit(1024.0**power)))
    return out.otherwise(F.format_string("%.1f TiB", n / F.lit(1024.0**4)))


def resolution_token(res: Column) -> Column:
    """30 -> 30m, 0.5 -> 0p5m."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", res), r"0+$", ""), r"\.$", "")
    return F.concat(F.regexp_replace(text, r"\.", "p"), F.lit("m"))


def to_number(text: Column) -> Column:
    """NULL for what is no number."""
    return text.try_cast("double")


def _tag(tags: Column, key: str) -> Column:
    """The value whose key is ``key`` in any case; the last one if there are several, NULL if it is blank."""
    found = F.filter(F.map_entries(tags), lambda e: F.lower(e.key) == key)
    value = F.try_element_at(found, F.lit(-1)).getField("value")
    return F.when(F.trim(value) != "", value)


def _in_range(nm: Column) -> Column:
    return F.when((nm >= NM_RANGE[0]) & (nm <= NM_RANGE[1]), nm)


def to_nanometres(value: Column, unit: Column) -> Column:
    """By the unit if it is known, otherwise by the size of the number."""
    chain = None
    for name, f in NM_PER_UNIT.items():
        hit = F.lower(F.trim(unit)) == name
        chain = F.when(hit, f) if chain is None else chain.when(hit, f)
    return value * F.coalesce(chain, F.when(value < MICROMETRES_BELOW, 1000.0).otherwise(1.0))


def wavelength_nm(band_tags: Column, imagery_tags: Column, description: Column) -> Column:
    """Struct (nm, source) of a band: from its tags, the imagery domain, or its description."""
    unit = F.coalesce(*[_tag(band_tags, k) for k in UNIT_KEYS])
    tagged = F.coalesce(*[_in_range(to_nanometres(_tag(band_tags, k).try_cast("double"), unit)) for k in WAVELENGTH_KEYS])
    domain = _in_range(_tag(imagery_tags, "central_wavelength_um").try_cast("double") * 1000.0)
    number, word = F.regexp_extract(description, DESCRIPTION, 1).try_cast("double"), F.regexp_extract(description, DESCRIPTION, 2)
    described = _in_range(to_nanometres(number, word))
    source = F.when(tagged.isNotNull(), "band_tag").when(domain.isNotNull(), "imagery_domain").when(described.isNotNull(), "description")
    return F.struct(F.coalesce(tagged, domain, described).alias("nm"), source.alias("source"))
