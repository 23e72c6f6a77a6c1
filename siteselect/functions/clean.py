"""Cleaning of text, numbers, flags and tags, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag values and keys that the categories are defined by.
RETAIL_AMENITIES = ("marketplace", "restaurant", "cafe", "fast_food", "food_court", "bar", "pub", "biergarten", "bank", "atm")
EDUCATION_AMENITIES = ("school", "college", "university", "kindergarten", "childcare", "language_school", "music_school", "driving_school")
HEALTH_AMENITIES = ("hospital", "clinic", "doctors", "dentist", "pharmacy")
TRANSPORT_AMENITIES = ("bus_station", "ferry_terminal", "taxi")
TRANSPORT_RAILWAYS = ("station", "halt", "tram_stop", "subway_entrance")
TRANSPORT_AEROWAYS = ("terminal", "aerodrome")
MAIN_ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link")
AC_SOCKETS = ("type1", "type2", "type3a", "type3c", "schuko", "cee_blue", "cee_red_16a", "cee_red_32a", "cee_red_63a", "tesla_destination")
DC_SOCKETS = ("type1_combo", "type2_combo", "chademo", "nacs", "tesla_supercharger", "gb_t_dc")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1", "evet"), ("false", "no", "0")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Null becomes empty, white space collapses to one blank, the ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " "))


def first_number(c: Column | str) -> Column:
    """The first number in a text, comma or point as decimal mark; null if there is none or it is negative."""
    value = F.regexp_extract(F.translate(_c(c), ",", "."), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(value >= 0, value)


def strict_number(c: Column | str) -> Column:
    """A non-negative finite number that is the whole text, else null."""
    value = F.replace(F.trim(_c(c)), F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value >= 0) & (value < float("inf")), value)


def integer_or(c: Column | str, default: int = 0) -> Column:
    """Rounded half to even and not below 0; the default where the text is no number."""
    value = _c(c).try_cast("double")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.greatest(F.bround(value), F.lit(0.0)).cast("long"))


def float_or(c: Column | str, default: float = 0.0) -> Column:
    value = _c(c).try_cast("double")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.greatest(value, F.lit(0.0)))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\D", "")


def tag_values(c: Column | str) -> Column:
    """Flatten nested lists; trim; drop empty ones; keep the first of equal values."""
    return F.array_distinct(F.filter(F.transform(F.flatten(_c(c)), lambda x: F.trim(x)), lambda x: x != ""))


def join_tags(c: Column | str) -> Column:
    return F.array_join(tag_values(c), ";")


def green_flag(c: Column | str) -> Column:
    """1 for yes, evet, true or 1, dotless i folded to i; else 0."""
    return F.translate(F.lower(clean_text(c)), "ı", "i").isin(*TRUE_WORDS).cast("int")


def current_type(c: Column | str) -> Column:
    up = F.upper(clean_text(c))
    return F.when(up.startswith("AC"), "AC").when(up.startswith("DC"), "DC").otherwise("UNKNOWN")


def boolean(c: Column | str, strict: bool = False) -> Column:
    """Booleans, 0/1 and yes/no text; anything else is false, or an error if strict."""
    word = F.lower(F.trim(_c(c).cast("string")))
    other = F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(word, F.lit("null")))).cast("boolean") if strict else F.lit(False)
    return F.when(word.isin("true", "yes", "1", "1.0"), True).when(word.isin("false", "no", "0", "0.0"), False).otherwise(other)


def socket_available(c: Column | str) -> Column:
    """no, 0, false and none are not available, yes and true are; else any part between semicolons above 0."""
    word = F.lower(clean_text(c))
    parts = F.exists(F.split(word, ";"), lambda x: F.coalesce(F.trim(x).try_cast("double") > 0, F.lit(False)))
    return F.when(word.isin("", "no", "0", "false", "none"), False).when(word.isin("yes", "true"), True).otherwise(parts)


def socket_count(c: Column | str) -> Column:
    """Sum of the positive numbers between semicolons."""
    parts = F.transform(F.split(clean_text(c), ";"), lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)))
    return F.aggregate(F.filter(parts, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x)


def socket_keys(tags: Column | str) -> Column:
    """Names of the available sockets in a tag map, sorted."""
    return F.array_sort(F.transform(F.map_keys(F.map_filter(_c(tags), lambda k, v: k.startswith("socket:") & socket_available(v))), lambda k: F.substring(k, 8, 100)))


def prepared_stations(elements: DataFrame, order: str = "pos", tags: str = "tags") -> DataFrame:
    """Stations from map elements (type, id, tags, ...): station_id is type_id, of equal ones the first by `order` stays, and the socket tags become
    connectors (sorted, joined by ;), how many kinds and sockets are known, and AC and DC flags; capacity as a number. Rows without a type or id go."""
    keyed = elements.where("type is not null and id is not null").withColumn("station_id", F.concat_ws("_", F.col("type"), F.col("id").cast("string")))
    others = [c for c in keyed.columns if c != "station_id"]
    first = keyed.groupBy("station_id").agg(F.min_by(F.struct(*others), order).alias("_s")).select("station_id", "_s.*")
    keys = socket_keys(tags)
    counts = F.aggregate(F.transform(keys, lambda k: socket_count(F.element_at(_c(tags), F.concat(F.lit("socket:"), k)))), F.lit(0.0), lambda a, n: a + n)
    return first.withColumns(
        {
            "connector_types": F.array_join(keys, ";"),
            "mapped_socket_type_count": F.size(keys),
            "known_socket_count": counts,
            "has_ac": has_any(keys, AC_SOCKETS),
            "has_dc": has_any(keys, DC_SOCKETS),
            "capacity_numeric": strict_number(clean_text(F.element_at(_c(tags), F.lit("capacity")))),
        }
    )


def has_any(keys: Column | str, of: Sequence[str]) -> Column:
    return F.arrays_overlap(_c(keys), F.array(*[F.lit(x) for x in of]))


def is_main_road(highway: Column | str, main: Sequence[str] = MAIN_ROADS) -> Column:
    return F.coalesce(has_any(highway, main), F.lit(False))


def tag(tags: Column | str, key: str) -> Column:
    """A tag in lower case; no, none, null and empty count as absent (an empty string)."""
    value = F.lower(F.trim(F.coalesce(F.element_at(_c(tags), F.lit(key)), F.lit(""))))
    return F.when(value.isin("no", "none", "null"), "").otherwise(value)


def categories(tags: Column | str) -> dict[str, Column]:
    """Four activity categories, which may overlap. Vacant or closed shops and offices do not count."""
    of = lambda k: tag(tags, k)
    in_use = lambda v: (v != "") & ~v.isin("vacant", "closed")
    amenity = of("amenity")
    return {
        "is_retail_commercial": in_use(of("shop")) | in_use(of("office")) | amenity.isin(*RETAIL_AMENITIES),
        "is_education": amenity.isin(*EDUCATION_AMENITIES),
        "is_healthcare": (of("healthcare") != "") | amenity.isin(*HEALTH_AMENITIES),
        "is_transport_activity": (of("public_transport") != "") | (of("highway") == "bus_stop") | of("railway").isin(*TRANSPORT_RAILWAYS) | amenity.isin(*TRANSPORT_AMENITIES) | of("aeroway").isin(*TRANSPORT_AEROWAYS),
    }


def unique_text(order: Column | str, value: Column | str, sep: str = ";") -> Column:
    """Aggregate: the distinct non-empty texts of a group in the order of `order`."""
    rows = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), clean_text(value).alias("v"))))
    return F.array_join(F.array_distinct(F.filter(F.transform(rows, lambda r: r["v"]), lambda v: v != "")), sep)


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; texts that are no number, NaN and infinite values become null."""
    def fine(c: str) -> Column:
        v = F.col(c).cast("string").try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    return df.withColumns({c: fine(c) for c in columns})


def binary(c: Column | str) -> Column:
    v = _c(c).cast("string").try_cast("double")
    return F.when(v.isin(0.0, 1.0), v.cast("int"))


def padded_id(number: Column | str, prefix: str, digits_: Column | int = 6) -> Column:
    width = F.lit(digits_) if isinstance(digits_, int) else digits_
    return F.concat(F.lit(prefix), F.lpad(_c(number).cast("string"), width, "0"))


def first_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of the candidates that df has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} is a column")


POLYGONS, LINES = ("Polygon", "MultiPolygon"), ("LineString", "MultiLineString")


def usable(kind: Column | str, points: Column | str, kinds: Sequence[str] = POLYGONS, least: int = 3) -> Column:
    """Whether a geometry is there, of one of the wanted kinds and has points enough."""
    return F.coalesce(_c(kind).isin(*kinds) & (F.size(_c(points)) >= least), F.lit(False))


def stations(df: DataFrame, id_col: str, capacity: str, flags: Sequence[str]) -> DataFrame:
    """Merged stations with a trimmed id, capacities that are numbers of 0 or more, else null, and flags from numeric text; empty and repeated ids raise when read."""
    number = _c(capacity).cast("string").try_cast("double")
    out = df.withColumns({id_col: F.trim(_c(id_col).cast("string")), capacity: F.when(number >= 0, number), **{f: F.coalesce(_c(f).cast("string").try_cast("double"), F.lit(0.0)) > 0 for f in flags}})
    n = out.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"))
    bad = F.when(F.coalesce(F.col("_id"), F.lit("")) == "", F.raise_error(F.lit(f"empty {id_col}"))).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {id_col}: "), "_id"))).otherwise(F.col("_id"))
    return out.join(n, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn(id_col, bad.cast("string")).drop("_id", "_n")


def provenance(df: DataFrame, order: Column | str, keys: Sequence[str], prefix: str = "K_", out: str = "scoped_id", buffer_m: float | None = None) -> DataFrame:
    """df with chunk_id, chunk_order and an id that is unique over chunks; with buffer_m also the chunk's buffer."""
    chunk = padded_id(order, prefix, 3)
    stamped = df.withColumns({"chunk_id": chunk, "chunk_order": _c(order).cast("long"), out: F.concat_ws("_", chunk, *[_c(k).cast("string") for k in keys])})
    return stamped.withColumn("chunk_buffer_m", F.lit(float(buffer_m))) if buffer_m is not None else stamped
