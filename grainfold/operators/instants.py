"""Timestamps of mixed formats and zones as one UTC instant.

Each value is read by every format that fits it, in every zone it may be meant in. What comes out is
a set of readings (format, zone, instant): a date with slashes may be day first or month first, bare
digits may count seconds, milliseconds or microseconds, a value without zone may be in the zone of its
source or in UTC. A mixture model of each source decides: a reading is as likely as the share of its
format times the share of its zone in the source, the shares are fitted by expectation-maximisation to
all values of the source, and what the source declares of itself enters as a prior of ``DECLARED``
values. The instant of the highest posterior is taken; below ``CERTAIN`` the value is marked ambiguous.

A date that only fits an order the source doesn't declare may be a misprint, which is a reading without
instant: a few of them stay ambiguous, many show that the declaration is wrong. Likewise a value without
zone in a source of unknown zone may be of any zone. Only counts per source and set of readings enter
the model, never the values.

Defined cases: surrounding white space is ignored; null, impossible and other values have no instant
(status ``missing`` or ``unreadable``). Without zone or offset the zone of the source holds; if it is
null or unknown the value is ``ambiguous``. A wall-clock time that occurs twice is the first one; one
that never occurs is taken with the offset before the gap. Fractions are cut off at microseconds.
Repeated rows come out repeatedly.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions.paths import trimmed
from grainfold.plans.runtime import cut, once

#: Least posterior of a decision; most rounds of the fit; how many values a declaration is worth.
CERTAIN, ROUNDS, DECLARED = 0.9, 200, 1000.0
#: Share of the values under a declared order that are expected to be misprints, and how likely a misprint is to be
#: a date of the other order (it may have any two digits in both places) against a real one of that order.
MISPRINTS, BY_CHANCE = 0.05, 0.04

# Zone abbreviations of Europe and North America, with their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}
MONTHS = "january february march april may june july august september october november december".split()

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
ZONE = r"[ ]?([Zz]|[+-]\d{2}:?\d{2}|[A-Z]{1,4}T|UTC)?(?:\[[^\]]*\])?"
#: Name, pattern, and its fields: year, month, day, hour, minute, second, fraction, half of the day, zone.
#: The two orders of a date with slashes have one pattern; its month and day are as written.
CLOCK = rf"(?:,?[ ]{TIME}(?:[ ]?([AaPp])[Mm])?{ZONE})?"
FORMATS = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{TIME}{ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("basic", r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?([Zz]|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    ("mail", rf"^(?:[A-Za-z]{{3}},[ ]+)?(\d{{1,2}})[ ]+([A-Za-z]{{3,9}})[ ]+(\d{{4}})[ ]+{TIME}{ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    ("words", rf"^(\d{{1,2}})[ ]([A-Za-z]{{3,9}})[ ](\d{{4}}){CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("month_first_words", rf"^([A-Za-z]{{3,9}})[ ](\d{{1,2}}),[ ](\d{{4}}){CLOCK}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    ("dots", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){CLOCK}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    ("epoch", r"^(\d{9,17})$", "$1|1|1||||||"),
]
#: Digits of an epoch in each unit, and microseconds of the unit: from the year 1973 on, to 5138. Where two units fit, both are readings.
UNITS = [("epoch_s", 9, 11, 1_000_000), ("epoch_ms", 11, 14, 1000), ("epoch_us", 14, 17, 1)]


def month_number(c: Column) -> Column:
    """From digits, a name or its first three letters."""
    table = {m[:3]: k for k, m in enumerate(MONTHS, 1)} | {m: k for k, m in enumerate(MONTHS, 1)} | {"sept": 9}
    names = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(c.try_cast("int"), F.try_element_at(names, F.lower(c)))


def wall_clock(month: Column, day: Column) -> Column:
    """Microseconds of the wall-clock time in column ``parts``, as if it were UTC; NULL if it is impossible."""
    field = lambda k: F.when(F.col("parts")[k] != "", F.col("parts")[k])
    number = lambda k, default: F.coalesce(field(k).try_cast("int"), F.lit(default))
    half, hour = F.lower(field(7)), number(3, 0)
    hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    fraction = F.rpad(F.substring(F.coalesce(field(6), F.lit("0")), 1, 6), 6, "0").try_cast("int")
    whole = F.try_make_timestamp(number(0, 0), month_number(month), day.try_cast("int"), hour, number(4, 0), number(5, 0).cast("decimal(16,6)"), F.lit("UTC"))
    return F.when((number(0, 0) > 0) & (number(5, 0) < 60), F.unix_micros(whole) + fraction)


def offset_minutes(zone: Column) -> Column:
    """Of Z, an offset or an abbreviation; NULL if it is none of them."""
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    numeric = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    return F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(table, F.upper(zone)))


def interpreted(df: DataFrame) -> DataFrame:
    """``df`` (text, zone, order) with found: array of (form, zone, us) of every possible reading."""
    packed = F.lit(None).cast("string")
    for name, pattern, fields in reversed(FORMATS):
        packed = F.when(F.col("text").rlike(pattern), F.concat(F.regexp_replace("text", pattern, fields), F.lit("|" + name))).otherwise(packed)
    df = once(df, "parts", F.split(packed, r"\|"))
    part = lambda k: F.col("parts")[k]
    slashes, calendar = part(9) == "slashes", F.col("parts").isNotNull() & (part(9) != "epoch")
    df = once(df, "first", F.when(calendar, wall_clock(part(1), part(2))))
    df = once(df, "second", F.when(slashes, wall_clock(part(2), part(1))))
    df = once(df, "offset", F.when(part(8) != "", offset_minutes(part(8))))
    reading = lambda form, zone, us: F.struct(form.alias("form"), (F.lit(zone) if isinstance(zone, str) else zone).alias("zone"), us.cast("bigint").alias("us"))
    digits, number = F.char_length(part(0)), part(0).try_cast("bigint")
    found = [F.when((part(9) == "epoch") & digits.between(low, high) & (number >= 10 ** (low - 1)), reading(F.lit(unit), "written", number * us)) for unit, low, high, us in UNITS]
    no_zone, known = part(8) == "", F.col("zone").isNotNull()
    for local, form in (("first", F.when(slashes, "dmy").otherwise(part(9))), ("second", F.lit("mdy"))):
        is_date, at = F.col(local).isNotNull(), F.col(local)
        found += [
            F.when(is_date & F.col("offset").isNotNull(), reading(form, "written", at - F.col("offset").cast("bigint") * 60_000_000)),
            F.when(is_date & no_zone & known, reading(form, "source", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("zone"))))),
            F.when(is_date & no_zone, reading(form, "utc", at)),
            F.when(is_date & no_zone & ~known, reading(form, "elsewhere", F.lit(None))),
        ]
    against = (F.col("order") == "dmy") & F.col("first").isNull() & F.col("second").isNotNull() | (F.col("order") == "mdy") & F.col("second").isNull() & F.col("first").isNotNull()
    found.append(F.when(slashes & against & (no_zone | F.col("offset").isNotNull()), reading(F.lit("misprint"), F.when(~no_zone, "written").when(known, "source").otherwise("utc"), F.lit(None))))
    return once(df, "found", F.when(F.col("text").isNotNull(), F.array_compact(F.array(*found)))).drop("parts", "first", "second", "offset")


def mixture(rows: pd.DataFrame) -> pd.DataFrame:
    """Posteriors of the readings of each set of readings of one source.

    Columns source, forms, zones (of the readings), n, declared (order or None), zoned (zone known).
    """
    declared, zoned = rows.declared.dropna(), bool(rows.zoned.any())
    n = rows.n.to_numpy(float)
    # Every reading: the set it belongs to, its form and its zone.
    of = np.repeat(np.arange(len(rows)), [len(f) for f in rows.forms])
    forms, form = np.unique(np.concatenate([np.asarray(f, object) for f in rows.forms]).astype(str), return_inverse=True)
    zones, zone = np.unique(np.concatenate([np.asarray(z, object) for z in rows.zones]).astype(str), return_inverse=True)
    order = declared.iloc[0] if len(declared) else None
    form_prior = np.array([1.0 + DECLARED * (f == order) if f != "misprint" else MISPRINTS * DECLARED for f in forms])
    zone_prior = np.array([1.0 + DECLARED * (zoned and z == "source") for z in zones])
    chance = np.where(forms[form] == "misprint", BY_CHANCE, 1.0)
    form_share, zone_share = form_prior / form_prior.sum(), zone_prior / zone_prior.sum()
    for _ in range(ROUNDS):
        likely = form_share[form] * zone_share[zone] * chance
        posterior = likely / np.bincount(of, likely)[of]
        counts = posterior * n[of]
        new_form, new_zone = form_prior + np.bincount(form, counts, len(forms)), zone_prior + np.bincount(zone, counts, len(zones))
        new_form, new_zone = new_form / new_form.sum(), new_zone / new_zone.sum()
        change = max(np.abs(new_form - form_share).max(), np.abs(new_zone - zone_share).max())
        form_share, zone_share = new_form, new_zone
        if change < 1e-9:
            break
    likely = form_share[form] * zone_share[zone] * chance
    posterior = likely / np.bincount(of, likely)[of]
    ends = np.cumsum([len(f) for f in rows.forms])[:-1]
    return pd.DataFrame({"source": rows.source, "forms": rows.forms, "zones": rows.zones, "posteriors": [p.tolist() for p in np.split(posterior, ends)]})


def instants(df: DataFrame, sources: DataFrame) -> DataFrame:
    """(ref_table, ref_id, value, utc_us, format, posterior, status) of rows (ref_table, ref_id, source, value).

    sources has (source, zone, date_order); the mixture is of each source, null too.
    """
    df = df.select("ref_table", "ref_id", "source", "value")
    known = sorted(available_timezones())
    zone, order = F.when(F.col("zone").isin(known), F.col("zone")), F.lower("date_order")
    clean = sources.select("source", zone.alias("zone"), F.when(order.isin("dmy", "mdy"), order).alias("order")).dropDuplicates(["source"])
    read = interpreted(df.join(clean, "source", "left").withColumn("text", trimmed(F.col("value"))))
    # Written once, as the model and its use both read it.
    read = cut(read.select("ref_table", "ref_id", "source", "value", "found", F.col("found.form").alias("forms"), F.col("found.zone").alias("zones"), "order", F.col("zone").isNotNull().alias("zoned")))
    sets = read.where(F.size("found") > 0).groupBy("source", "forms", "zones").agg(F.count("*").alias("n"), F.max("order").alias("declared"), F.max("zoned").alias("zoned"))
    kind = df.schema["source"].dataType.simpleString()
    # One group for each source: as many rows as it has kinds of readings, however many values.
    fitted = sets.groupBy("source").applyInPandas(mixture, f"source {kind}, forms array<string>, zones array<string>, posteriors array<double>")
    fitted = fitted.withColumnsRenamed({c: f"m_{c}" for c in ("source", "forms", "zones")})
    same = F.col("source").eqNullSafe(F.col("m_source")) & (F.col("forms") == F.col("m_forms")) & (F.col("zones") == F.col("m_zones"))
    judged = read.join(fitted, same, "left")
    # Readings of one instant stand together.
    each = F.arrays_zip("found", "posteriors")
    total = lambda us: F.aggregate(each, F.lit(0.0), lambda acc, x: acc + F.when(x["found"]["us"].eqNullSafe(us), x["posteriors"]).otherwise(0.0))
    best = F.array_max(F.transform(each, lambda x: F.struct(F.round(total(x["found"]["us"]), 9).alias("posterior"), x["posteriors"].alias("own"), x["found"]["form"].alias("format"), x["found"]["us"].alias("us"))))
    judged = once(judged, "best", best)
    certain = F.col("best.us").isNotNull() & (F.col("best.posterior") >= CERTAIN)
    status = F.when(F.col("value").isNull(), "missing").when(F.size("found") == 0, "unreadable").when(certain, "resolved").otherwise("ambiguous")
    return judged.select("ref_table", "ref_id", "value", F.when(status == "resolved", F.col("best.us")).alias("utc_us"), F.col("best.format").alias("format"), F.col("best.posterior").alias("posterior"), status.alias("status"))
