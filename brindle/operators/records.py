"""Extracted records: first of equals, conventions, validation, normal forms, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes of records and the profile each conforms to.
CLASSES = ["LearningResource", "CreativeWork", "TrainingMaterial", "Course", "CourseInstance", "Event"]
PROFILES = {
    "CourseInstance": "https://bioschemas.org/profiles/CourseInstance/1.0-RELEASE",
    "Course": "https://bioschemas.org/profiles/Course/1.0-RELEASE",
}
DEFAULT_PROFILE = "https://bioschemas.org/profiles/TrainingMaterial/1.1-DRAFT"


def first_of_equals(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first record of each key by order; null keys are a key of their own. Partial aggregation, no sort."""
    others = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def conforms_to(type_: Column) -> Column:
    """The profile of a record's type, by the first class name that it contains."""
    out = F.lit(DEFAULT_PROFILE)
    for name, iri in reversed(PROFILES.items()):
        out = F.when(type_.contains(name), iri).otherwise(out)
    return out


def record_id(id_: Column, url: Column, fallback: Column) -> Column:
    """A record's own id, else its address, else the fallback; empty counts as missing."""
    return F.coalesce(F.nullif(id_, F.lit("")), F.nullif(url, F.lit("")), fallback)


def violations() -> Column:
    """ARRAY<STRING>: what is wrong with a record, as `path: message`; empty for a valid one."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    iso_date = r"^\d{4}(-\d{2}(-\d{2}([T ].*)?)?)?$"
    event = F.coalesce(F.col("type").isin("CourseInstance", "Event"), F.lit(False))
    checks = [
        (F.col("type").isNull(), "@type: is required"),
        (F.col("type").isNotNull() & ~F.col("type").isin(*CLASSES), "@type: is no known class"),
        (blank(F.col("name")), "name: is required"),
        (F.col("url").isNotNull() & ~F.col("url").rlike(r"^https?://\S+$"), "url: is no address"),
        (event & F.col("start_date").isNotNull() & ~F.col("start_date").rlike(iso_date), "startDate: is no ISO date"),
        (event & F.col("end_date").isNotNull() & ~F.col("end_date").rlike(iso_date), "endDate: is no ISO date"),
        (F.col("start_date") > F.col("end_date"), "endDate: is before startDate"),
        (~event & blank(F.col("description")), "description: is required"),
    ]
    return F.array_compact(F.array(*[F.when(test, message) for test, message in checks]))


def report_line(label: Column, errors: Column) -> Column:
    return F.when(F.size(errors) == 0, F.concat(label, F.lit(": valid"))).otherwise(F.concat(label, F.lit(": "), F.array_join(errors, "; ")))


def language_tag(tag: Column) -> Column:
    """The language of a tag, before any region."""
    return F.lower(F.trim(F.split_part(tag, F.lit("-"), F.lit(1))))


def level(raw: Column) -> Column:
    """Beginner, intermediate or advanced, however it is written; else null."""
    low = F.lower(F.trim(raw))
    return F.when(low.rlike("begin|basic|intro|novice"), "beginner").when(low.rlike("inter|medium"), "intermediate").when(low.rlike("adv|expert"), "advanced")


def orcid(text: Column) -> Column:
    """The ORCID in a text, if any."""
    return F.nullif(F.regexp_extract(text, r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit(""))


def completeness() -> Column:
    """The share of a record's descriptive fields that are filled in."""
    texts = ["name", "description", "url", "keywords", "teaches", "license", "educational_level", "time_required"]
    filled = sum((F.coalesce(F.trim(c) != "", F.lit(False)).cast("int") for c in texts[1:]), F.coalesce(F.trim(texts[0]) != "", F.lit(False)).cast("int"))
    lists = sum((F.coalesce(F.size(c) > 0, F.lit(False)).cast("int") for c in ("author", "in_language")), F.lit(0))
    return F.round((filled + lists) / 10, 2)


def common_prefix(urls_of: DataFrame, group: str, path: str) -> DataFrame:
    """(group, prefix): the longest common beginning of the paths of a group, in whole segments.

    The common beginning of a set is that of its least and greatest member, so two
    aggregates are enough and no group is gathered.
    """
    ends = urls_of.groupBy(group).agg(F.min(F.split(path, "/")).alias("lo"), F.max(F.split(path, "/")).alias("hi"))
    n = F.least(F.size("lo"), F.size("hi"))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at("lo", i) == F.element_at("hi", i))
    length = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n)
    return ends.select(group, F.array_join(F.slice("lo", 1, length.cast("int")), "/").alias("prefix"))


def end_date(start: Column, end: Column, duration: Column) -> Column:
    """A record's own end, else the last day of as many days (P3D) as it takes from its start; hours and minutes end on the day they start."""
    day = F.left(start, F.lit(10)).try_cast("date")
    days = F.regexp_extract(duration, r"^P(\d+)D$", 1).try_cast("int")
    counted = F.when(days.isNotNull() & day.isNotNull(), F.date_add(day, days - 1).cast("string")).when(duration.rlike(r"^PT\d+[HM]$"), F.left(start, F.lit(10)))
    return F.coalesce(end, counted)


def doi(text: Column) -> Column:
    """The DOI in a text or address, if any."""
    return F.nullif(F.regexp_extract(text, r"\b(10\.\d{4,9}/[^\s\"'<>]*[^\s\"'<>.,;)])", 1), F.lit(""))


def is_online(mode: Column, location: Column) -> Column:
    """Whether any of a record's modes (an array) or its place (VARIANT) says that it is held online."""
    by_mode = F.exists(F.coalesce(mode, F.array().cast("array<string>")), lambda m: F.lower(m).isin("online", "virtual", "remote"))
    return by_mode | F.coalesce(F.try_variant_get(location, '$["@type"]', "string") == "VirtualLocation", F.lit(False))


def flat_location(location: Column) -> Column:
    """STRUCT<venue, city, country, latitude, longitude> of a place (VARIANT): what isn't given is null, blanks count as not given."""
    paths = {"venue": "$.name", "city": "$.address.addressLocality", "country": "$.address.addressCountry", "latitude": "$.geo.latitude", "longitude": "$.geo.longitude"}
    given = {n: F.nullif(F.trim(F.try_variant_get(location, p, "string")), F.lit("")) for n, p in paths.items()}
    return F.struct(*[(c.try_cast("double") if n in ("latitude", "longitude") else c).alias(n) for n, c in given.items()])
