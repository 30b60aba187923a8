"""Timestamps of mixed formats, precisions and zones, brought to one instant in UTC.

Every value is read under each format that can read it. Where more than one can, the formats' shares per source,
fitted by expectation-maximisation over all values of that source, choose; what stays undecided is marked.
All parsing is done by Spark expressions; only the fit, over counts per (source, set of formats), runs in Python.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans import cut, join_small

# Month names of the supported languages.
MONTHS = {
    1: "january jan januar januari janvier janv enero ene",
    2: "february feb februar februari février févr fév febrero",
    3: "march mar mars marts märz mär marzo",
    4: "april apr avril avr abril abr",
    5: "may mai maj mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug augusti août aoû agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec desember des dezember dez décembre déc diciembre dic",
}
# Zone abbreviations and their offsets in minutes; a second entry applies to sources in a zone named there.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
                 "IST": 330, "JST": 540, "AEST": 600, "AEDT": 660, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
                 "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600}
ABBREVIATIONS_OF_ZONE = {"Europe/Dublin": {"IST": 60}, "Asia/Jerusalem": {"IST": 120}, "Asia/Shanghai": {"CST": 480}}

_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"(?:\s*(Z|z|(?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5}|[A-Za-z_]+(?:/[A-Za-z_+-]+)+)?(?:\[[^\]]*\])?)"
_AP = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_DAY = r"(?:[\p{L}]{2,10}\.?,?\s+)?"
_MON = r"(\p{L}{3,10})\.?"
#: name, pattern of the whole trimmed value, template "Y|M|D|h|m|s|fraction|a or p|zone", prior weight.
CIVIL = [
    ("iso", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[Tt]|\s+){_T})?{_ZONE}", "$1|$2|$3|$4|$5|$6|$7||$8", 1.0),
    ("year-day-month", rf"(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:[Tt]|\s+){_T})?{_ZONE}", "$1|$3|$2|$4|$5|$6|$7||$8", 1e-6),
    ("basic", r"(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,12}))?)?(Z|z|[+-]\d{2}:?(?:\d{2})?)?", "$1|$2|$3|$4|$5|$6|$7||$8", 1.0),
    ("basic-day-first", r"(\d{2})(\d{2})(\d{4})()()()()()", "$3|$2|$1||||||", 1e-3),
    ("slash-year", rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:\s+{_T}{_AP})?{_ZONE}", "$1|$2|$3|$4|$5|$6|$7|$8|$9", 1.0),
    ("slash-dmy", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_T}{_AP})?{_ZONE}", "$3|$2|$1|$4|$5|$6|$7|$8|$9", 1.0),
    ("slash-mdy", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_T}{_AP})?{_ZONE}", "$3|$1|$2|$4|$5|$6|$7|$8|$9", 1.0),
    ("dots", rf"(\d{{1,2}})\.\s?(\d{{1,2}})\.\s?(\d{{4}}|\d{{2}})(?:,?\s+(?:kl\.?\s*)?{_T.replace(':(', '[:.](')}{_AP})?{_ZONE}", "$3|$2|$1|$4|$5|$6|$7|$8|$9", 1.0),
    ("day-name-month", rf"{_DAY}(\d{{1,2}})[.]?[\s/-]+(?:de\s+)?{_MON}[\s/,-]+(?:de\s+)?(\d{{4}}|\d{{2}})(?:,?\s+(?:(?:kl|klo|um|à|at)\.?\s*)?{_T.replace(':(', '[:.](')}{_AP})?{_ZONE}", "$3|$2|$1|$4|$5|$6|$7|$8|$9", 1.0),
    ("month-name-day", rf"{_DAY}{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_T}{_AP})?{_ZONE}", "$3|$1|$2|$4|$5|$6|$7|$8|$9", 1.0),
    ("ctime", rf"\p{{L}}{{3}}\s+{_MON}\s+(\d{{1,2}})\s+{_T}{_ZONE}\s+(\d{{4}})", "$8|$1|$2|$3|$4|$5|$6||$7", 1.0),
    ("year-first-digits", r"(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})()()()", "$1|$2|$3|$4|$5||||", 1e-6),
]
#: name, pattern, microseconds a unit (ns as a divisor), prior weight.
EPOCH = [
    ("epoch-s", r"-?\d{9,11}(?:\.\d{1,9})?", 1_000_000, 1.0),
    ("epoch-ms", r"-?\d{12,13}", 1_000, 1.0),
    ("epoch-us", r"-?\d{15,16}", 1, 1.0),
    ("epoch-ns", r"-?\d{18,19}", 0, 1.0),
]
NAMES = [f[0] for f in CIVIL] + [f[0] for f in EPOCH]
PRIOR = np.array([f[3] for f in CIVIL] + [f[3] for f in EPOCH])
DMY, MDY = NAMES.index("slash-dmy"), NAMES.index("slash-mdy")
#: A choice whose posterior is below this is marked ambiguous.
SURE = 0.95
#: The prior weights count as so many values of each format (so two values that only one order can read make it sure), and the most rounds.
PSEUDO, ROUNDS = 0.1, 5_000


def expectation_maximisation(counts: np.ndarray, masks: np.ndarray, alpha: np.ndarray, rounds: int = ROUNDS, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """The formats' shares, and the rounds taken (`rounds` + 1: not converged).

    The E step shares each set's values out among its formats by the shares so far; the M step adds the pseudo-counts alpha
    (Dirichlet) once. Where few values tell formats apart plain steps get ever smaller, so each round extrapolates two of
    them (squared iterative method) and keeps the result if the posterior density doesn't fall. It ends when the way that is
    left, by the ratio of two steps, is under the tolerance.
    """
    def step(pi: np.ndarray) -> np.ndarray:
        w = masks * pi
        new = (counts[:, None] * w / np.maximum(w.sum(1, keepdims=True), 1e-300)).sum(0) + alpha
        return new / new.sum()

    def density(pi: np.ndarray) -> float:
        return float(counts @ np.log(np.maximum(masks @ pi, 1e-300)) + alpha @ np.log(np.maximum(pi, 1e-300)))

    pi = alpha / alpha.sum()
    for k in range(1, rounds + 1):
        one = step(pi)
        two = step(one)
        r, v = one - pi, two - 2 * one + pi
        now, then = np.sqrt(r @ r), np.sqrt((two - one) @ (two - one))
        if now < 1e-15 or (then < now and then * then / (now - then) < tolerance):
            return two, k
        far = two
        if np.abs(v).max() > 0:
            length = max(1.0, now / np.sqrt(v @ v))
            far = pi + 2 * length * r + length * length * v
            far = step(np.maximum(far, 1e-300) / np.maximum(far, 1e-300).sum()) if far.min() > 0 else two
            if density(far) < density(two):
                far = two
        pi = far
    return pi, rounds + 1


def fit_mixture(counts: np.ndarray, masks: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior of each format for each set of formats. counts: values with that set; masks: sets x formats, 0 or 1;
    prior: weights that decide among formats as long as no value tells them apart. A fit that didn't converge leaves sets of
    several formats undecided (all their formats equal)."""
    pi, took = expectation_maximisation(counts, masks, np.maximum(prior * PSEUDO, 1e-12))
    w = masks * (pi if took <= ROUNDS else 1.0)
    return w / np.maximum(w.sum(1, keepdims=True), 1e-300)


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    masks = np.array([[(int(m) >> k) & 1 for k in range(len(NAMES))] for m in pdf["_mask"]], float)
    order = pdf["_order"].dropna()
    if len(order):  # the order that isn't declared is no reading, but where it is the only one
        declared = masks.copy()
        declared[:, MDY if order.iloc[0] == "dmy" else DMY] = 0
        masks = np.where(declared.any(1, keepdims=True), declared, masks)
    post = fit_mixture(pdf["_n"].to_numpy(float), masks, PRIOR)
    best = post.argmax(1)
    return pd.DataFrame({"_source": pdf["_source"], "_mask": pdf["_mask"], "_fmt": best.astype("int32"), "_posterior": post[np.arange(len(best)), best]})


def _int(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))


def _readings(value: Column) -> Column:
    """The value's parts under each format that can read it: array<struct<fmt, y, mo, d, h, mi, s, us, zone, epoch, odd>>.

    Each pattern is tried once; only what matches is rewritten to "Y|M|D|h|m|s|fraction|a or p|zone" and taken apart.
    """
    civil = F.array(*[F.when(value.rlike(f"^{f[1]}$"), F.struct(F.lit(k).alias("fmt"), F.regexp_replace(value, f"^{f[1]}$", f[2]).alias("t"))) for k, f in enumerate(CIVIL)])
    civil = F.transform(F.filter(civil, lambda c: c.isNotNull()), lambda c: F.struct(c["fmt"].alias("fmt"), F.split(c["t"], r"\|", -1).alias("p")))
    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for w in names.split() for x in (w, n)])

    def numbers(c: Column) -> Column:
        p = c["p"]
        return F.struct(
            c["fmt"].alias("fmt"), p[0].try_cast("int").alias("y"), F.length(p[0]).alias("yl"), F.when(p[1].rlike(r"^\d+$"), p[1].try_cast("int")).otherwise(F.try_element_at(months, F.lower(p[1]))).alias("mo"), p[2].try_cast("int").alias("d"),
            _int(p[3]).alias("h"), _int(p[4]).alias("mi"), _int(p[5]).alias("s"), F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("int").alias("us"), F.lower(p[7]).alias("half"), p[8].alias("zone"),
        )

    def parts(n: Column) -> Column:
        twelve = n["half"].isin("a", "p")
        return F.struct(
            n["fmt"].alias("fmt"), F.when(n["yl"] == 2, n["y"] + 2000).otherwise(n["y"]).alias("y"), n["mo"].alias("mo"), n["d"].alias("d"),
            F.when(n["half"] == "p", n["h"] % 12 + 12).when(n["half"] == "a", n["h"] % 12).otherwise(n["h"]).alias("h"), n["mi"].alias("mi"), n["s"].alias("s"), n["us"].alias("us"), n["zone"].alias("zone"),
            F.lit(None).cast("bigint").alias("epoch"), (twelve & ~n["h"].between(1, 12)).alias("odd"),
        )

    civil = F.transform(F.transform(civil, numbers), parts)
    number = value.try_cast("decimal(30,9)")

    def epoch(k: int) -> Column:
        name, pattern, unit, _ = EPOCH[k]
        us = (F.try_divide(number, F.lit(1000)) if not unit else number * unit).try_cast("bigint")
        null = lambda t: F.lit(None).cast(t)
        return F.when(value.rlike(f"^{pattern}$"), F.struct(F.lit(len(CIVIL) + k).alias("fmt"), *[null("int").alias(x) for x in ("y", "mo", "d", "h", "mi", "s", "us")], null("string").alias("zone"), us.alias("epoch"), F.lit(False).alias("odd")))

    return F.concat(civil, F.when(value.rlike(r"^-?\d{9,19}(?:\.\d+)?$"), F.filter(F.array(*[epoch(k) for k in range(len(EPOCH))]), lambda c: c.isNotNull())).otherwise(F.array().cast("array<struct<fmt:int,y:int,mo:int,d:int,h:int,mi:int,s:int,us:int,zone:string,epoch:bigint,odd:boolean>>")))


def _valid(c: Column) -> Column:
    civil = (
        c["y"].between(1, 9999) & c["mo"].between(1, 12) & (c["d"] >= 1) & (c["h"] < 24) & (c["mi"] < 60) & (c["s"] < 60) & ~c["odd"]
        & (c["d"] <= F.when(c["mo"].isin(4, 6, 9, 11), 30).when(c["mo"] == 2, F.when(((c["y"] % 4 == 0) & (c["y"] % 100 != 0)) | (c["y"] % 400 == 0), 29).otherwise(28)).otherwise(31))
    )
    return F.when(c["epoch"].isNotNull(), F.lit(True)).otherwise(F.coalesce(civil, F.lit(False)))


def _micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ of whole seconds, whatever the session's zone."""
    return F.expr(f"(datediff(cast({ts} as date), date'1970-01-01') * 86400L + hour({ts}) * 3600L + minute({ts}) * 60L + cast(second({ts}) as bigint)) * 1000000L")


def normalise_timestamps(df: DataFrame, value: str, source: str, zone: str | None = None, order: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One instant in UTC for each row of `df`.

    value: the column with the text; source: the column whose values name the sources among which formats are learnt;
    zone: the column with the zone of wall times without one (null or unknown: UTC); order: the column with `dmy` or `mdy`,
    the order a source declares between slashes (null: learnt; else the other one counts only where it alone can be read). keep: the columns to carry along (default: all but value).

    Result: `keep`, then epoch_us (null: no time is stated), format, posterior, ambiguous (posterior under 0.95),
    clock ("gap", "overlap": a wall time that its zone skips or repeats; the offset before the change and the first pass are
    taken), zoned (the value names its own zone). Null, blank, filler and relative values give nulls and stay in the result;
    repeated rows stay; an empty input gives an empty result; other columns of any name don't matter.
    """
    keep = [c for c in df.columns if c != value] if keep is None else keep
    none = F.lit(None).cast("string")
    base = df.select(
        F.struct(*[F.col(c) for c in keep]).alias("_keep"),
        F.trim(F.regexp_replace(F.col(value).cast("string"), r"[\s ]+", " ")).alias("_v"),
        F.concat_ws("\0", F.coalesce(F.col(source).cast("string"), F.lit("")), F.lower(F.col(order)) if order else none).alias("_source"),  # a source with two orders is two
        (F.col(zone) if zone else none).alias("_tz"),
        (F.lower(F.col(order)) if order else none).alias("_order"),
    )
    v = F.col("_v")
    read = base.withColumn("_c", F.filter(F.when(v.rlike(r"\d"), _readings(v)), _valid))
    read = read.withColumn("_mask", F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(F.expr("1L").cast("bigint") * F.pow(F.lit(2.0), c["fmt"]).cast("bigint"))))
    counts = read.filter("_mask > 0").groupBy("_source", "_mask").agg(F.count("*").alias("_n"), F.max(F.when(F.col("_order").isin("dmy", "mdy"), F.col("_order"))).alias("_order"))
    fitted = cut(counts.groupBy("_source").applyInPandas(_fit_source, "_source string, _mask long, _fmt int, _posterior double"))
    one = join_small(read, fitted, ["_source", "_mask"]).withColumn("_p", F.try_element_at(F.filter("_c", lambda c: c["fmt"] == F.col("_fmt")), F.lit(1)))
    zones = sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix", "right", "System")))
    known = F.col("_tz").isin(*zones, "UTC")
    text = F.col("_p.zone")
    offset = F.regexp_extract(text, r"^(?:GMT|UTC)?([+-])(\d{1,2}):?(\d{2})?$", 1)
    minutes = F.regexp_extract(text, r"^(?:GMT|UTC)?[+-](\d{1,2}):?(\d{2})?$", 1).cast("int") * 60 + F.coalesce(F.expr("try_cast(nullif(regexp_extract(_p.zone, '^(?:GMT|UTC)?[+-][0-9]{1,2}:?([0-9]{2})?$', 1), '') as int)"), F.lit(0))
    short = F.create_map(*[F.lit(x) for k, n in ABBREVIATIONS.items() for x in (k, n)])
    short = F.try_element_at(short, F.upper(text))
    for z, own in ABBREVIATIONS_OF_ZONE.items():
        for k, n in own.items():
            short = F.when((F.col("_tz") == z) & (F.upper(text) == k), n).otherwise(short)
    one = one.withColumns({
        "_off": F.when(offset == "+", minutes).when(offset == "-", -minutes).otherwise(short),
        "_region": F.when(text.isin(*zones), text).when(known, F.col("_tz")).otherwise(F.lit("UTC")),
        "_wall": F.expr("try_make_timestamp_ntz(_p.y, _p.mo, _p.d, _p.h, _p.mi, cast(_p.s as decimal(8,6)))"),
    })
    one = one.withColumn("_utc", F.when(F.col("_off").isNull(), F.expr("convert_timezone(_region, 'UTC', _wall)")))
    one = one.withColumns({"_back": F.expr("convert_timezone('UTC', _region, _utc)"), "_later": F.expr("convert_timezone('UTC', _region, _utc + interval 1 hour)")})
    us = F.when(F.col("_p.epoch").isNotNull(), F.col("_p.epoch")).when(F.col("_off").isNotNull(), _micros("_wall") - F.col("_off").cast("bigint") * 60_000_000).otherwise(_micros("_utc")) + F.when(F.col("_p.epoch").isNull(), F.col("_p.us")).otherwise(0)
    names = F.array(*[F.lit(n) for n in NAMES])
    return one.select(
        "_keep.*",
        us.alias("epoch_us"),
        F.try_element_at(names, F.col("_p.fmt") + 1).alias("format"),
        F.when(F.col("_p").isNotNull(), F.col("_posterior")).alias("posterior"),
        F.when(F.col("_p").isNotNull(), F.col("_posterior") < SURE).alias("ambiguous"),
        F.when(F.col("_utc").isNotNull(), F.when(F.col("_back") != F.col("_wall"), "gap").when(F.col("_later") == F.col("_wall"), "overlap")).alias("clock"),
        F.when(F.col("_p").isNotNull(), F.col("_p.epoch").isNotNull() | F.col("_off").isNotNull() | text.isin(*zones)).alias("zoned"),
    )
