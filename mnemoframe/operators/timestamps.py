"""Mixed timestamp formats and zones to one UTC instant in microseconds.

Every accepted format is one alternative of a single regular expression with named groups. One replacement pulls all
components out of a value at once; calendar ranges are checked on the components; the instant is assembled by integer
day arithmetic. Everything stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names, and the zone abbreviations in use with their offsets in minutes.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
_DOW = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*"
_ZONE = r"Z|[+-]\d{2}:?\d{2}|\[?[A-Za-z]+(?:[_/+-][A-Za-z0-9]+)*\]?"
_HALF = r"[AaPp]\.?[Mm]\.?"

# One alternative per format. Group names end in the letter of their alternative: y year, o month number, n month name,
# d day, a and b day and month in the order of the locale, h hour, i minute, s second, f fraction, p half of the day,
# z zone, e epoch digits, g decimal part of epoch digits.
FORMATS = {
    "A": rf"(?<yA>\d{{4}})-(?<oA>\d{{1,2}})-(?<dA>\d{{1,2}})(?:[T ](?<hA>\d{{1,2}}):(?<iA>\d{{2}})(?::(?<sA>\d{{2}})(?:[.,](?<fA>\d+))?)? ?(?<zA>{_ZONE})?)?",
    "B": rf"(?<yB>\d{{4}})(?<oB>\d{{2}})(?<dB>\d{{2}})T(?<hB>\d{{2}})(?<iB>\d{{2}})(?<sB>\d{{2}})(?<zB>{_ZONE})?",
    "C": rf"(?<yC>\d{{4}})/(?<oC>\d{{1,2}})/(?<dC>\d{{1,2}})(?: \({_DOW}\))?(?: (?<hC>\d{{1,2}}):(?<iC>\d{{2}})(?::(?<sC>\d{{2}}))?)?",
    "D": rf"(?<aD>\d{{1,2}})[/.](?<bD>\d{{1,2}})[/.](?<yD>\d{{4}})(?:,? (?<hD>\d{{1,2}}):(?<iD>\d{{2}})(?::(?<sD>\d{{2}}))?(?: ?(?<pD>{_HALF}))?)?",
    "E": rf"(?:(?<hE>\d{{1,2}}):(?<iE>\d{{2}})(?::(?<sE>\d{{2}}))?(?: ?(?<pE>{_HALF}))? on )?(?<dE>\d{{1,2}}) (?<nE>{_MONTH}),? (?<yE>\d{{4}})",
    "G": rf"(?:{_DOW}, )?(?<dG>\d{{1,2}}) (?<nG>{_MONTH}) (?<yG>\d{{4}}) (?<hG>\d{{1,2}}):(?<iG>\d{{2}})(?::(?<sG>\d{{2}}))?(?: (?<zG>{_ZONE}))?",
    "H": r"(?<yH>\d{4})年(?<oH>\d{1,2})月(?<dH>\d{1,2})日(?: ?(?<hH>\d{1,2})時(?:(?<iH>\d{1,2})分(?:(?<sH>\d{1,2})秒)?)?)?",
    "I": r"(?<eI>1\d{18}|\d{1,18})(?:\.(?<gI>\d*))?",
}
_SEP = "\u0001"
_FIELDS = "yodabehisnfpzg"  # the digits first
_PATTERN = "^(?i:" + "|".join(FORMATS.values()) + ")$"
_TEMPLATE = _SEP.join("".join(f"${{{f}{a}}}" for a, p in FORMATS.items() if f"(?<{f}{a}>" in p) for f in _FIELDS)


def _components(value: Column) -> Column:
    """Array of the components in the order of _FIELDS, '' where absent; one element where no format fits."""
    text = F.regexp_replace(F.regexp_replace(value, r"[\s\p{Z}]+", " "), "^ | $", "")
    return F.split(F.regexp_replace(text, _PATTERN, _TEMPLATE), _SEP)


def known_zones(df: DataFrame) -> list[str]:
    """Zone names of the JVM's rules; a name outside them can't be resolved."""
    return sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def with_instants(df: DataFrame, raw: str, tz: str | None = None, locale: str | None = None) -> DataFrame:
    """df with epoch_us: UTC microseconds of the time text in column raw, NULL where it denotes no instant.

    tz and locale name columns for times without a zone of their own and for the order of day and month. A wall-clock
    time that occurs twice means the first, a skipped one is moved on by the gap: the rules of the JVM's zoned
    date-times, which to_utc_timestamp follows. Each step is a projection of its own, so nothing is computed twice.
    """
    keep = df.columns
    zones = known_zones(df)
    text = lambda f: f"get(_c, {_FIELDS.index(f)})"
    num = lambda f: f"get(_n, {_FIELDS.index(f)})"
    month_names = ", ".join(f"'{m[:3].lower()}'" for m in MONTHS)
    abbreviations = ", ".join(f"'{k}', {v * 60}L" for k, v in ZONE_MINUTES.items())
    month_first = f"coalesce(lower(replace({locale}, '-', '_')) IN ('en_us', 'us'), false)" if locale else "false"
    d = df.withColumn("_c", _components(F.col(raw))).withColumn("_c", F.when(F.size("_c") == len(_FIELDS), F.col("_c")))
    # The pattern lets only digits through, so an ordinary cast of what isn't empty can't fail; try_cast is far slower.
    # Higher-order functions keep these projections out of the fused stage: as one method it is too large for the JIT.
    d = d.selectExpr(
        *keep,
        "transform(slice(_c, 1, 9), x -> CAST(nullif(x, '') AS BIGINT)) AS _n",
        f"array_position(array({month_names}), lower(substr({text('n')}, 1, 3))) AS _name",
        f"lower(substr({text('p')}, 1, 1)) AS _p",
        f"CAST(rpad(substr({text('f')}, 1, 6), 6, '0') AS BIGINT) AS _f",
        f"regexp_replace({text('z')}, '[\\\\[\\\\]]', '') AS _z",
        f"CAST(rpad(substr({text('g')}, 1, 6), 6, '0') AS BIGINT) AS _g",
    )
    d = d.selectExpr(
        *keep, "_z", "_g", "_p",
        f"{num('y')} AS _y", f"{num('e')} AS _e", f"{num('h')} AS _h",
        f"CASE WHEN _name > 0 THEN _name WHEN {num('a')} IS NULL THEN {num('o')} WHEN {month_first} THEN {num('a')} ELSE {num('b')} END AS _m",
        f"CASE WHEN {num('a')} IS NULL THEN {num('d')} WHEN {month_first} THEN {num('b')} ELSE {num('a')} END AS _d",
        "aggregate(slice(_n, 7, 3), 0L, (acc, x) -> acc * 60 + coalesce(x, 0L)) * 1000000 + _f AS _clock",
        "NOT exists(slice(_n, 8, 2), x -> coalesce(x, 0L) > 59) AS _real",
    )
    # The calendar year starts in March here, so that the leap day comes last.
    d = d.selectExpr(
        *keep, "_z", "_e", "_g", "_d",
        "_y - if(_m <= 2, 1, 0) AS _yy",
        "if(_m <= 2, _m + 9, _m - 3) AS _mm",
        "CASE WHEN _m IN (4, 6, 9, 11) THEN 30 WHEN _m <> 2 THEN 31 WHEN _y % 4 = 0 AND (_y % 100 <> 0 OR _y % 400 = 0) THEN 29 ELSE 28 END AS _last",
        "_real AND _y >= 1 AND _m BETWEEN 1 AND 12 AND _d >= 1 AND if(_p = '', coalesce(_h, 0L) <= 23, _h BETWEEN 1 AND 12) AS _real",
        "_clock + CASE WHEN _p = 'p' AND _h < 12 THEN 43200000000 WHEN _p = 'a' AND _h = 12 THEN -43200000000 ELSE 0L END AS _clock",
        f"CASE WHEN _z = '' THEN NULL WHEN _z RLIKE '^[+-]' THEN if(substr(_z, 1, 1) = '-', -60L, 60L) * (CAST(substr(_z, 2, 2) AS BIGINT) * 60 + CAST(right(_z, 2) AS BIGINT)) ELSE element_at(map({abbreviations}), upper(_z)) END AS _offset",
    )
    d = d.selectExpr(
        *keep, "_z", "_offset",
        "if(_real AND _d <= _last, (_yy * 365 + _yy div 4 - _yy div 100 + _yy div 400 + (_mm * 153 + 2) div 5 + _d - 719469) * 86400000000 + _clock, NULL) AS _wall",
        # Digits alone: the unit is the one that gives a date in the years 2020 to 2026.
        "CASE WHEN _e BETWEEN 1577836800 AND 1798761599 THEN _e * 1000000 + _g WHEN _e BETWEEN 1577836800000 AND 1798761599999 THEN _e * 1000 + _g div 1000 WHEN _e BETWEEN 1577836800000000 AND 1798761599999999 THEN _e WHEN _e BETWEEN 1577836800000000000 AND 1798761599999999999 THEN _e div 1000 END AS _epoch",
    )
    named = F.when(F.col("_z") != "", F.col("_z")).otherwise(F.col(tz) if tz else F.lit("UTC"))
    own = F.col("_z") != ""
    zone = F.when(named.isin(zones), named).when(~own, "UTC")
    zoned = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_wall"), zone))
    return d.select(*keep, F.coalesce("_epoch", F.col("_wall") - F.col("_offset") * 1000000, zoned).alias("epoch_us"))


def _present(df: DataFrame, table: str, key: str) -> DataFrame:
    """(source_table, row_key, epoch_us) of the rows with an instant.

    An exploded array of none or one value takes the place of a filter: the optimizer would copy the whole parsing into
    a filter and compute it twice.
    """
    found = F.explode(F.filter(F.array("epoch_us"), lambda x: x.isNotNull()))
    return df.select(F.lit(table).alias("source_table"), F.col(key).cast("string").alias("row_key"), found.alias("epoch_us"))


#: Each session is repeated so often in the join, and the rows of a session are spread over the copies: a session that
#: holds a third of all turns is then no task of its own.
SESSION_SALTS = 8


def normalise_times(turns: DataFrame, sessions: DataFrame, samples: DataFrame) -> DataFrame:
    """(source_table, row_key, epoch_us): one row per raw time of the three tables that denotes an instant.

    A zone or offset in the value holds; else the tz of the row's session (UTC where it is NULL or unknown), and always
    UTC for samples. The session's locale gives the order of day and month in all-numeric dates: month first for en_US,
    day first otherwise. Nulls, empty texts, placeholders and impossible dates give no row, and neither does a NULL row
    key. Identical deliveries of a row give one row; copies of one key with different times give one row for each. Turns
    without a known session count as UTC. Only the named columns are read, so further columns can't clash.
    """
    ses = sessions.select("session_id", "session_time", "tz", "locale").where("session_id IS NOT NULL")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SESSION_SALTS - 1)))
    one = ses.groupBy("session_id").agg(F.min(F.struct("tz", "locale")).alias("z")).select("session_id", "z.tz", "z.locale", salts.alias("salt"))
    raw = turns.where("turn_id IS NOT NULL AND turn_time IS NOT NULL").select("turn_id", "session_id", "turn_time", F.pmod(F.xxhash64("turn_id"), F.lit(SESSION_SALTS)).cast("int").alias("salt"))
    # The join's partitioning by (session_id, salt) serves the removal of repeated rows too.
    joined = raw.join(one, ["session_id", "salt"], "left")
    of_turns = _present(with_instants(joined, "turn_time", "tz", "locale"), "turns", "turn_id")
    of_sessions = _present(with_instants(ses.distinct(), "session_time", "tz", "locale"), "sessions", "session_id")
    asked = samples.select("sample_id", "question_time").where("sample_id IS NOT NULL").distinct()
    of_samples = _present(with_instants(asked, "question_time"), "samples", "sample_id")
    return of_turns.unionByName(of_sessions).unionByName(of_samples).distinct()
