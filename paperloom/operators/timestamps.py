"""Normalising written dates and times of mixed formats and zones.

An ordered cascade of anchored patterns; the first that matches decides how a value is read, and reading is
strict (no rolling over of impossible dates). Everything is a column expression, so the whole cascade runs inside
the scan stage without a shuffle; only the small lookup of the source's zone and day order is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import once

# English month abbreviations, zone abbreviations in hours from UTC, military zone letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONE_HOURS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "JST": 9,
}
MILITARY_EAST = "ABCDEFGHIKLM"  # +1 .. +12
MILITARY_WEST = "NOPQRSTUVWXY"  # -1 .. -12

_MON = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? )?"
_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(z|utc|gmt|ut|[ecmp][sd]t|jst|[+-]\d{2}(?::?\d{2})?)"

#: name, anchored pattern over the trimmed value (case ignored), the field that each group fills.
#: y year of 4 digits, v year of 2, m month number, n month name, d day, a/b slashed pair, h:i:s.f time,
#: p am/pm, z zone, l military letter, e epoch seconds, t epoch milliseconds
CASCADE: list[tuple[str, str, str]] = [
    ("year", r"(\d{4})", "y"),
    ("year_month", r"(\d{4})-(\d{2})", "ym"),
    ("compact_date", r"(\d{4})(\d{2})(\d{2})", "ymd"),
    ("epoch_seconds", r"(\d{9,10})", "e"),
    ("epoch_millis", r"(\d{11,13})", "t"),
    ("iso_time", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_HMS} ?{_ZONE}?", "ymdhisfz"),
    ("year_first_date", r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", "y_md"),
    ("slashed_time", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? {_HMS} ?(am|pm)? ?{_ZONE}?", "abyhisfpz"),
    ("slashed", r"(\d{1,2})/(\d{1,2})/(\d{4})", "aby"),
    ("slashed_short", r"(\d{1,2})/(\d{1,2})/(\d{2})", "abv"),
    ("slashed_month", r"(\d{1,2})/(\d{4})", "my"),
    ("dotted_time", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? {_HMS} ?{_ZONE}?", "dmyhisfz"),
    ("dotted", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "dmy"),
    ("dotted_short", r"(\d{1,2})\.(\d{1,2})\.(\d{2})", "dmv"),
    ("military", rf"(\d{{2}})(\d{{2}})(\d{{2}})([a-z]) {_MON}\.? (\d{{4}})", "dhilny"),
    ("military_short", rf"(\d{{2}})(\d{{2}})(\d{{2}})([a-z]) {_MON}\.? (\d{{2}})", "dhilnv"),
    ("day_month_time", rf"{_WEEKDAY}(\d{{1,2}})[ -]{_MON}\.?,?[ -](\d{{4}}),? (?:at )?{_HMS} ?(am|pm)? ?{_ZONE}?", "dnyhisfpz"),
    ("day_month", rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MON}\.?,?[ -](\d{{4}})", "dny"),
    ("day_month_short", rf"{_WEEKDAY}(\d{{1,2}})[ -]{_MON}\.?,?[ -](\d{{2}})", "dnv"),
    ("month_day_clock", rf"{_WEEKDAY}{_MON}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}) (\d{{2}})(\d{{2}}) ?{_ZONE}?", "ndyhiz"),
    ("month_day_time", rf"{_WEEKDAY}{_MON}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}),? (?:at )?{_HMS} ?(am|pm)? ?{_ZONE}?", "ndyhisfpz"),
    ("month_day", rf"{_WEEKDAY}{_MON}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", "ndy"),
    ("month_year", rf"{_MON}\.?,? (\d{{4}})", "ny"),
]

_FIELDS = "yvmndabhisfpzlet"
_MS_DAY = 86_400_000


def _cascade(s: Column) -> Column:
    """The fields of the first pattern that matches, each a string; null where none does."""
    out = None
    for name, pattern, groups in CASCADE:
        anchored = rf"(?i)\A{pattern}\z"
        at = {g: i + 1 for i, g in enumerate(groups)}
        text = {f: F.regexp_extract(s, anchored, at[f]) if f in at else F.lit("") for f in _FIELDS}
        fields = F.struct(F.lit(name).alias("pattern"), *[text[f].alias(f) for f in _FIELDS])
        out = F.when(s.rlike(anchored), fields) if out is None else out.when(s.rlike(anchored), fields)
    return out


def _number(text: Column) -> Column:
    return F.when(text != "", text).try_cast("int")


def _zone_minutes(z: Column, letter: Column) -> Column:
    """Minutes from UTC of a written zone; null where none is written or the letter J (local) is."""
    fixed = {**{k: 60 * v for k, v in ZONE_HOURS.items()}}
    military = {"Z": 0, **{c: 60 * (i + 1) for i, c in enumerate(MILITARY_EAST)}, **{c: -60 * (i + 1) for i, c in enumerate(MILITARY_WEST)}}
    lookup = lambda known, key: reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), known.items(), F.when(F.lit(False), F.lit(0)))
    sign = F.when(F.substring(z, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    digits = F.rpad(F.regexp_replace(z, "[^0-9]", ""), 4, "0")
    signed = sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))
    return F.when(letter != "", lookup(military, F.upper(letter))).when(z.rlike("^[+-]"), signed).when(z != "", lookup(fixed, F.upper(z)))


def _day_text(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / _MS_DAY).cast("int")).cast("string")


def _instant_text(ms: Column) -> Column:
    of_day = F.pmod(ms, F.lit(_MS_DAY))
    part = lambda div, mod, width: F.lpad(F.pmod(F.floor(of_day / div), F.lit(mod)).cast("string"), width, "0")
    return F.concat(_day_text(ms), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def normalize_timestamps(df: DataFrame, id_col: str, date_col: str, profiles: DataFrame, source_col: str | None = "source", source: str | None = None) -> DataFrame:
    """One row per input row: row_id, written, normal_form, granularity, pattern, status.

    normal_form is YYYY, YYYY-MM, YYYY-MM-DD or YYYY-MM-DDTHH:MM:SS.mmmZ and keeps the precision of the written
    value; it is null unless status is `ok`. Other states: `empty` (null or blank value), `unread` (no pattern matches:
    ranges, approximations, words), `impossible` (a pattern matches, the calendar doesn't), `no_profile` (a slashed
    date or local time whose source has no row in `profiles`), `skipped` and `repeated` (a local time that a clock
    change leaves out or passes twice; neither is guessed).

    `profiles` has source, zone and slash_order (`mdy` or `dmy`); if it repeats a source, the alphabetically first
    zone and order count. `source` gives the source of all rows, for tables without such a column. Repeated rows give
    repeated results; other columns of `df` are ignored, whatever their names; an empty table gives an empty result.
    """
    src = F.lit(source) if source is not None else F.col(source_col).cast("string")
    rows = df.select(F.col(id_col).alias("row_id"), F.col(date_col).cast("string").alias("written"), src.alias("_source"))
    known = profiles.groupBy(F.col("source").cast("string").alias("_source")).agg(F.min("zone").alias("_zone"), F.min("slash_order").alias("_order"))
    trimmed = F.regexp_replace("written", r"(?U)\A[\s\[\](){}<>]+|[\s\[\](){}<>]+\z", "")
    if source is None:
        rows = rows.join(known, "_source", "left")
    else:  # one row of the lookup, so its values are constants
        zone, order = known.filter(F.col("_source") == source).select("_zone", "_order").first() or (None, None)
        rows = rows.withColumns({"_zone": F.lit(zone).cast("string"), "_order": F.lit(order).cast("string")})
    f = rows.withColumn("_s", F.regexp_replace(trimmed, r"(?U)\s+", " "))
    f = once(f, _f=_cascade(F.col("_s")))

    g = {k: F.col(f"_f.{k}") for k in _FIELDS}
    month_name = reduce(lambda c, im: c.when(F.lower(F.substring(g["n"], 1, 3)) == im[1], F.lit(im[0] + 1)), enumerate(MONTHS), F.when(F.lit(False), F.lit(0)))
    slashed = g["a"] != ""
    month_first = F.col("_order") == "mdy"
    a, b = _number(g["a"]), _number(g["b"])
    hour, half = _number(g["h"]), F.lower(g["p"])
    hour = (
        F.when(half == "", hour)
        .when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "pm", F.lit(12)).otherwise(F.lit(0)))
    )
    f = once(
        f,
        _y=F.when(g["v"] != "", F.lit(1900) + _number(g["v"])).otherwise(_number(g["y"])),
        _m=F.when(g["n"] != "", month_name).when(slashed, F.when(month_first, a).otherwise(b)).otherwise(_number(g["m"])),
        _d=F.when(slashed, F.when(month_first, b).otherwise(a)).otherwise(_number(g["d"])),
        _h=hour,
        _i=F.coalesce(_number(g["i"]), F.lit(0)),
        _sec=F.coalesce(_number(g["s"]), F.lit(0)),
        _ms=F.when(g["f"] != "", F.rpad(F.substring(g["f"], 1, 3), 3, "0").try_cast("int")).otherwise(F.lit(0)),
        _off=_zone_minutes(g["z"], g["l"]),
        _epoch=F.when(g["e"] != "", g["e"].try_cast("long") * 1000).when(g["t"] != "", g["t"].try_cast("long")),
        _slashed=slashed,
        _grain=F.when(F.concat(g["e"], g["t"], g["h"]) != "", F.lit("instant"))
        .when((g["d"] != "") | slashed, F.lit("day")).when((g["m"] != "") | (g["n"] != ""), F.lit("month"))
        .when(F.col("_f").isNotNull(), F.lit("year")),
    )
    utc = F.lit("UTC")
    day = F.coalesce(F.col("_d"), F.lit(1))
    is_local = (F.col("_grain") == "instant") & F.col("_epoch").isNull() & F.col("_off").isNull()
    # A wall clock is kept as the instant that shows it in UTC, so nothing depends on the session's zone.
    made = F.try_make_timestamp(F.col("_y"), F.coalesce(F.col("_m"), F.lit(1)), day, F.coalesce(F.col("_h"), F.lit(0)), F.col("_i"), F.col("_sec").cast("decimal(8,6)"), utc)
    f = once(f, _wall=F.when(F.col("_epoch").isNull() & F.col("_y").between(1, 9999) & (F.col("_sec") < 60) & (F.coalesce(F.col("_h"), F.lit(0)) < 24), made))
    # The zone's offset well before and well after the wall clock: a local time exists once if the readings by
    # both offsets agree or only one of them shows the written time again.
    zone = F.when(is_local, F.col("_zone"))
    before = F.unix_millis(F.from_utc_timestamp(F.col("_wall") - F.expr("INTERVAL 1 DAY"), zone)) - F.unix_millis(F.col("_wall") - F.expr("INTERVAL 1 DAY"))
    after = F.unix_millis(F.from_utc_timestamp(F.col("_wall") + F.expr("INTERVAL 1 DAY"), zone)) - F.unix_millis(F.col("_wall") + F.expr("INTERVAL 1 DAY"))
    f = once(f, _w=F.unix_millis("_wall"), _b=before, _a=after)
    shows = lambda off: F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(F.col("_w") - off), F.col("_zone"))) == F.col("_w")
    f = once(f, _by_b=shows(F.col("_b")), _by_a=shows(F.col("_a")))
    local = F.when(F.col("_by_b"), F.col("_w") - F.col("_b")).when(F.col("_by_a"), F.col("_w") - F.col("_a"))

    bad_month = F.col("_grain").isin("month") & ~F.coalesce(F.col("_m").between(1, 12), F.lit(False))
    no_hour = (F.col("_grain") == "instant") & F.col("_epoch").isNull() & F.col("_h").isNull()
    status = (
        F.when(F.coalesce(F.col("_s"), F.lit("")) == "", F.lit("empty"))
        .when(F.col("_f").isNull(), F.lit("unread"))
        .when(F.col("_slashed") & F.col("_order").isNull(), F.lit("no_profile"))
        .when(F.col("_epoch").isNull() & (F.col("_wall").isNull() | bad_month | no_hour | (F.abs(F.col("_off")) > 15 * 60)), F.lit("impossible"))
        .when(is_local & F.col("_zone").isNull(), F.lit("no_profile"))
        .when(is_local & F.col("_by_b") & F.col("_by_a") & (F.col("_a") != F.col("_b")), F.lit("repeated"))
        .when(is_local & ~F.col("_by_b") & ~F.col("_by_a"), F.lit("skipped"))
        .otherwise(F.lit("ok"))
    )
    instant = F.coalesce(F.col("_epoch"), F.when(is_local, local).otherwise(F.col("_w") - F.col("_off") * 60_000)) + F.when(F.col("_epoch").isNull(), F.col("_ms")).otherwise(F.lit(0))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    form = (
        F.when(F.col("_grain") == "instant", _instant_text(instant))
        .when(F.col("_grain") == "day", _day_text(F.col("_w")))
        .when(F.col("_grain") == "month", F.concat_ws("-", pad(F.col("_y"), 4), pad(F.col("_m"), 2)))
        .otherwise(pad(F.col("_y"), 4))
    )
    f = once(f, _status=status)
    ok = F.col("_status") == "ok"
    return once(f, normal_form=F.when(ok, form), granularity=F.when(ok, F.col("_grain")), pattern=F.col("_f.pattern"), status=F.col("_status")).select("row_id", "written", "normal_form", "granularity", "pattern", "status")
