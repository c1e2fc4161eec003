"""Column expressions of the incident model. All are JVM-side; none is a Python UDF.

Instants are UTC; wall clocks are zone-less timestamps, so that gaps, sorts and windows run on the clock
that people read, also across daylight-saving changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zone of wall clocks; the latitude of the local metre grid and the metres of a degree.
ZONE = "America/Halifax"
REFERENCE_LATITUDE = 44.65
METRES_PER_DEGREE = 111_320.0


def epoch_to_utc(ms: Column) -> Column:
    """Epoch milliseconds, as a number or text, to an instant; null and empty text to null."""
    return F.timestamp_millis(F.nullif(ms.cast("string"), F.lit("")).cast("long"))


def epoch_ms(ts: Column) -> Column:
    """An instant to epoch milliseconds, rounded."""
    return F.round(F.unix_micros(ts) / 1000).cast("long")


def to_local(utc: Column, zone: str = ZONE) -> Column:
    """A zone-less UTC timestamp to the wall clock of ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def to_fixed_offset(utc: Column, hours: int = -3) -> Column:
    """The wall clock of a zone without daylight saving."""
    return utc + F.expr(f"interval {hours} hours")


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_address(raw: Column) -> Column:
    """Upper case, up to the first comma, white space collapsed; empty to null."""
    head = F.split_part(F.upper(raw), F.lit(","), F.lit(1))
    return F.nullif(strip(F.regexp_replace(head, r"(?U)\s+", " ")), F.lit(""))


def street_of(address: Column) -> Column:
    """An address without its civic number and without what follows an ampersand."""
    plain = F.regexp_replace(address, r"^\d+[A-Z]?\s+", "")
    return F.nullif(strip(F.regexp_replace(plain, r"(?s)\s*&.*$", "")), F.lit(""))


def vehicle_key(make: Column, model: Column, colour: Column) -> Column:
    """Trimmed upper-case parts as a struct; null if all are empty."""
    parts = [F.upper(strip(F.coalesce(c, F.lit("")))) for c in (make, model, colour)]
    key = F.struct(*[p.alias(n) for p, n in zip(parts, ("make", "model", "colour"), strict=True)])
    return F.when(F.concat(*parts) != "", key)


def tow_status(flag: Column) -> Column:
    """Y and N decoded; anything else, null too, is unknown."""
    return F.when(flag == "Y", "towed").when(flag == "N", "not_towed").otherwise("unknown")


def slug(name: Column) -> Column:
    """Lower case, other than letters and digits to '-', trimmed; 'type' if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(body, F.lit("")), F.lit("type"))


def title_case(text: Column) -> Column:
    """Each letter after a non-letter in upper case, the others in lower case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def utc_iso(ts: Column) -> Column:
    """An instant as UTC ISO text with microseconds; zone-less timestamps are taken as UTC."""
    return F.concat(F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def elapsed_minutes(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 60_000_000


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """A percentage rounded once, half to even, from the raw ratio; null for an empty whole."""
    return F.bround(F.try_divide(100.0 * part, whole.cast("double")), places)


def to_metres(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Local equirectangular coordinates in metres, east and north."""
    east = lon * METRES_PER_DEGREE * F.cos(F.radians(F.lit(REFERENCE_LATITUDE)))
    return east, lat * METRES_PER_DEGREE


def euclid(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def grid_cell(metres: Column, side: float | Column = 60.0) -> Column:
    return F.floor(metres / side)


def crosses(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A ray to the east from the point crosses the edge."""
    at = x1 + (lat - y1) / F.when(y2 != y1, y2 - y1) * (x2 - x1)
    return F.coalesce(((y1 > lat) != (y2 > lat)) & (lon < at), F.lit(False))


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of [lon, lat] points; the last vertex goes on to the first."""
    n = F.size(ring)
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"),
            F.get(ring, (i + 1) % n)[0].alias("x2"), F.get(ring, (i + 1) % n)[1].alias("y2"),
        ),
    )


def business_key(layer: str) -> Column:
    """The identity of a record that outlasts renumbering."""
    if layer == "service_requests":
        return F.col("request_id").cast("string")
    if layer == "custom_fields":
        return F.concat_ws(":", F.col("request_id").cast("string"), F.coalesce(F.col("field_id").cast("string"), F.lit("-")))
    return F.col("dauid").cast("string")


def score(calls_12mo: Column, tow_rate: Column) -> Column:
    """Calls that still arrive, weighted by how few ended in a tow."""
    return calls_12mo * (1 - tow_rate)


def per_thousand(calls: Column, dwellings: Column) -> Column:
    """Calls per 1,000 dwellings, one decimal; null without dwellings."""
    return F.bround(1000.0 * calls / F.nullif(dwellings, F.lit(0)).cast("double"), 1)


#: The multiplier and step of a 32-bit integer mix, the same in any SQL engine with 64-bit integers.
MIX, STEP, WORD = 0x45D9F3B, 0x9E3779B9, 0xFFFFFFFF


def mixed(x: Column) -> Column:
    """A number below 2 ** 32 as another one, so that near numbers come far apart; no two become the same."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * MIX).bitwiseAND(WORD)
    return x.bitwiseXOR(F.shiftright(x, 16))


def stream_of(seed: int, rep: Column, part: Column) -> Column:
    """What the draws of one part of one replicate are made from."""
    rep, part = rep.cast("long"), part.cast("long")
    return mixed((mixed((F.lit(seed).cast("long") + rep).bitwiseAND(WORD)) + part).bitwiseAND(WORD))


def draw(stream: Column, k: Column) -> Column:
    """The k-th draw of a stream, below 2 ** 32: a sum of two mixes, so that draws can repeat as chance has it."""
    k = k.cast("long")
    other = mixed(stream.bitwiseXOR(STEP))
    return (mixed(stream.bitwiseXOR(k)) + mixed((other + k).bitwiseAND(WORD))).bitwiseAND(WORD)
