"""Texts that name a moment, in many notations and zones, brought to one UTC instant.

Every text gets the instants of all notations under which it is a valid moment. Where more than one
remains, expectation maximisation over a mixture of notations, fitted per source, tells how likely each
reading is; the best one is taken if it is likely enough, else the value is marked as ambiguous.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import let, shelve, strip

# English month names and weekday names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\\.?,? +)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?: ?(z|utc|gmt|[+-]\d{2}(?::?\d{2})?|\[[a-z0-9_+/-]+\]|[a-z_]+(?:/[a-z0-9_+-]+)+))?"

#: Seconds since 1970 of 2001-01-01 and of 2101-01-01: what a bare number may count.
EPOCH_FROM, EPOCH_TO = 978_307_200, 4_133_980_800
#: A reading among several must be this likely to be taken.
LIKELY = 0.9
_DAY_MS = 86_400_000


class Notation(NamedTuple):
    """A way to write a moment. ``fields`` rewrites a match of ``pattern`` (on lower-cased text) as
    ``year|month|day|hour|minute|second|fraction|meridiem|zone``."""

    name: str
    pattern: str
    fields: str


def _notation(name: str, date: str, order: str) -> Notation:
    return Notation(name, f"^{date}(?:(?:,? +|t){_TIME}{_ZONE})?$", order + "|$4|$5|$6|$7|$8|$9")


NOTATIONS = [
    _notation("year-month-day", r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1|$2|$3"),
    Notation("year-month", r"^(\d{4})-(\d{2})$", "$1|$2|1||||||"),
    Notation("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    _notation("year/month/day", r"(\d{4})/(\d{1,2})/(\d{1,2})", "$1|$2|$3"),
    _notation("day.month.year", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "$3|$2|$1"),
    _notation("day/month/year", r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3|$2|$1"),
    _notation("month/day/year", r"(\d{1,2})/(\d{1,2})/(\d{4})", "$3|$1|$2"),
    _notation("day name year", _WEEKDAY + r"(\d{1,2})\.? " + _MONTH + r"\.?,? (\d{4})", "$3|$2|$1"),
    _notation("name day, year", _WEEKDAY + _MONTH + r"\.? (\d{1,2}),? (\d{4})", "$3|$1|$2"),
]


def zone_names(spark: SparkSession) -> dict[str, str]:
    """Lower-cased names of the regions that the JVM knows, a list of fixed size."""
    return {z.lower(): z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds()}


def bare_text(c: Column) -> Column:
    """``c`` in lower case, without outer blanks and quotes."""
    return F.lower(strip(F.regexp_replace(strip(c), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")))


def _instant(f: Column, home: Column, regions: Column) -> Column:
    """UTC milliseconds of the fields ``f`` of a notation; null if they are no valid moment."""
    # patterns let digits through only; a try_cast that fails makes an exception, which costs more than all else here
    whole = lambda c: F.when(c != "", c).cast("int")
    number = lambda i: F.coalesce(whole(F.get(f, i)), F.lit(0))
    month = F.get(f, 1)
    month = F.when(month.rlike("^[a-z]"), F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(month, 1, 3)).cast("string")).otherwise(month)
    valid = whole(month).between(1, 12) & whole(F.get(f, 2)).between(1, 31)
    date = F.when(valid, F.concat_ws("-", F.get(f, 0), F.lpad(month, 2, "0"), F.lpad(F.get(f, 2), 2, "0"))).try_cast("date")
    half, zone = F.get(f, 7), F.get(f, 8)

    def clock(hour: Column) -> Column:
        shown = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        ms = (shown * 3600 + number(4) * 60 + number(5)).cast("long") * 1000 + F.rpad(F.substring(F.get(f, 6), 1, 3), 3, "0").cast("long")
        return F.when((hour < 24) & (number(4) < 60) & (number(5) < 60) & ((half == "") | hour.between(1, 12)), ms)

    digits = F.regexp_replace(zone, ":", "")
    off_hour, off_minute = whole(F.substring(digits, 2, 2)), F.coalesce(whole(F.substring(digits, 4, 2)), F.lit(0))
    offset = F.when(zone.isin("z", "utc", "gmt"), F.lit(0)).when(zone.rlike(r"^[+-]") & (off_hour <= 18) & (off_minute < 60), (off_hour * 60 + off_minute) * F.when(zone.startswith("-"), -1).otherwise(1))
    region = F.when(zone == "", home).otherwise(F.try_element_at(regions, F.regexp_replace(zone, r"[\[\]]", "")))
    # to_utc_timestamp takes the first of two equal local times, and the offset before a skipped one
    utc = lambda ms: let(offset, lambda o: F.when(o.isNotNull(), ms - o.cast("long") * 60_000).otherwise(F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(ms), region))))
    return let(F.unix_date(date).cast("long") * _DAY_MS + let(number(3), clock), utc)


def readings(raw: Column, home: Column, regions: Column) -> Column:
    """All valid readings of ``raw``: array<struct<notation,epoch_ms>>, in the order of NOTATIONS."""

    def of(text: Column) -> Column:
        written = F.array_compact(
            F.array(*(F.when(text.rlike(n.pattern), F.struct(F.lit(n.name).alias("notation"), F.split(F.regexp_replace(text, n.pattern, n.fields), r"\|", -1).alias("f"))) for n in NOTATIONS))
        )
        dated = F.transform(written, lambda x: F.struct(x["notation"].alias("notation"), _instant(x["f"], home, regions).alias("epoch_ms")))
        finer = F.rpad(F.substring(F.split_part(text, F.lit("."), F.lit(2)), 1, 3), 3, "0").try_cast("long")
        counted = lambda n: F.array(
            F.struct(F.lit("seconds").alias("notation"), F.when(n.between(EPOCH_FROM, EPOCH_TO - 1), n * 1000 + finer).alias("epoch_ms")),
            F.struct(F.lit("milliseconds").alias("notation"), F.when(n.between(EPOCH_FROM * 1000, EPOCH_TO * 1000 - 1), n).alias("epoch_ms")),
        )
        number = F.when(text.rlike(r"^\d{1,18}(?:\.\d+)?$"), F.split_part(text, F.lit("."), F.lit(1)).cast("long"))
        return F.filter(let(number, lambda n: F.when(n.isNull(), dated).otherwise(counted(n))), lambda x: x["epoch_ms"].isNotNull())

    return let(bare_text(raw), of)


def region_map(spark: SparkSession) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(zone_names(spark).items()) for x in pair))


def fit_notations(counts: pd.DataFrame, *, rounds: int = 200, tolerance: float = 1e-9) -> pd.DataFrame:
    """EM for one source. ``counts``: source, signature (list of notations, by position), n.

    A value contributes the weight of each notation under which it is valid. Returns per signature the
    position of the likeliest reading and its posterior.
    """
    names = sorted({x for s in counts["signature"] for x in s})
    at = {x: i for i, x in enumerate(names)}
    valid = np.zeros((len(counts), len(names)))
    for r, s in enumerate(counts["signature"]):
        valid[r, [at[x] for x in s]] = 1
    n = counts["n"].to_numpy(float)
    weight = np.full(len(names), 1 / max(1, len(names)))
    for _ in range(rounds):
        share = valid * weight
        share /= share.sum(1, keepdims=True)
        new = n @ share / n.sum()
        done = np.abs(new - weight).max() < tolerance
        weight = new
        if done:
            break
    best = [int(np.argmax([weight[at[x]] for x in s])) for s in counts["signature"]]
    total = valid @ weight
    posterior = [weight[at[s[b]]] / t if t else 0.0 for s, b, t in zip(counts["signature"], best, total)]
    return pd.DataFrame({"source": counts["source"], "signature": counts["signature"], "pick": best, "posterior": posterior})


def settle(read: DataFrame, *, likely: float = LIKELY) -> DataFrame:
    """``read`` (source, readings and any others) with epoch_ms, notation, posterior and ambiguous: the likeliest of the
    readings of each row, by the habits of its source. ``read`` is used twice, so it should be stored."""
    read = read.withColumn("_signature", F.transform("readings", lambda x: x["notation"]))
    counts = read.where(F.size("_signature") > 0).groupBy("source", F.col("_signature").alias("signature")).agg(F.count("*").alias("n"))
    fitted = counts.groupBy("source").applyInPandas(fit_notations, "source string, signature array<string>, pick int, posterior double").where(F.size("signature") > 1)
    one = F.get("readings", F.coalesce("pick", F.lit(0)))
    same = F.size(F.array_distinct(F.transform("readings", lambda x: x["epoch_ms"]))) <= 1
    sure = F.coalesce(same | (F.coalesce("posterior", F.lit(1.0)) >= likely), F.lit(True))
    likeliest = F.when(F.size("readings") > 0, F.coalesce("posterior", F.lit(1.0)))
    held = [c for c in read.columns if c not in ("readings", "_signature")]
    return read.withColumnRenamed("_signature", "signature").join(fitted, ["source", "signature"], "left").select(
        *held, F.when(sure, one["epoch_ms"]).alias("epoch_ms"), F.when(sure, one["notation"]).alias("notation"), likeliest.alias("posterior"), (~sure).alias("ambiguous")
    )


def normalise_instants(rows: DataFrame, *, key: str, source: str, raw: str, zone: str, likely: float = LIKELY) -> DataFrame:
    """``key``, ``epoch_ms``, ``notation``, ``posterior``, ``ambiguous`` of every row of ``rows``.

    A text without zone is local time in ``zone``; a day means its midnight, a month its first day. A
    local time that occurs twice means the first, a skipped one is taken with the offset before the
    change. Texts that are null, blank or no valid moment, and local times without a known zone, give a
    null ``epoch_ms``; where several readings remain and none is ``likely``, it is null too and
    ``ambiguous`` is true. Readings of one and the same instant are not ambiguous. Repeated rows and keys
    stay as they are; other columns are ignored. A null source is a source of its own.
    """
    spark = rows.sparkSession
    src = F.coalesce(F.col(source), F.lit("")).alias("source")
    read = rows.select(F.col(key).alias("key"), src, readings(F.col(raw), F.col(zone), region_map(spark)).alias("readings"))
    return settle(shelve(read, "readings"), likely=likely).select(F.col("key").alias(key), "epoch_ms", "notation", "posterior", "ambiguous")
