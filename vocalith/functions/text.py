"""Scalar helpers: formatting, codecs, dates and validation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalith.functions.content import SIGNS
from vocalith.operators.keyed import trimmed

DASH = "—"
ZODIAC = ("aries", "taurus", "gemini", "cancer", "leo", "virgo", "libra", "scorpio", "sagittarius", "capricorn", "aquarius", "pisces")


def percent(p: Column) -> Column:
    return F.concat(F.floor(p * 100 + 0.5).cast("string"), F.lit("%"))


def hertz(x: Column) -> Column:
    return F.when(x.isNull(), DASH).otherwise(F.concat(F.floor(x + 0.5).cast("string"), F.lit(" Hz")))


def fixed2(x: Column) -> Column:
    """``x`` with two decimals, halves away from zero by the exact value that the double has.

    200 x is compared with odd numbers; its rounding error is found by splitting x into two halves of its digits.
    """
    y, split = F.abs(x), F.abs(x) * 134217729.0
    high = split - (split - y)
    product = y * 200.0
    error = (high * 200.0 - product) + (y - high) * 200.0
    below = F.floor((product + 1) / 2)  # cents if what was rounded away does not matter
    short = (product == 2 * below - 1) & (error < 0)
    past = (product == 2 * below + 1) & (error >= 0)
    cents = below - short.cast("long") + past.cast("long")
    whole = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when((x < 0) & (cents > 0), F.concat(F.lit("-"), whole)).otherwise(whole)


def duration(s: Column) -> Column:
    return F.concat(fixed2(s), F.lit(" s"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", "-")


def tags(x: Column) -> Column:
    """The non-blank parts of a comma list, trimmed."""
    return F.filter(F.transform(F.split(x, ","), trimmed), lambda t: t != "")


def joined(*parts: Column) -> Column:
    """Non-empty parts with a dot between them, or a dash."""
    some = [F.nullif(p, F.lit("")) for p in parts]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *some), F.lit("")), F.lit(DASH))


def first_hop(forwarded: Column, real: Column) -> Column:
    hop = F.nullif(trimmed(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))
    return F.coalesce(hop, F.nullif(real, F.lit("")), F.lit("unknown"))


def base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(x, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def share_code(name: Column, day: Column, bio: Column, template: Column, horoscope: Column) -> Column:
    parts = F.struct(name.alias("n"), day.alias("d"), bio.alias("b"), template.alias("t"), horoscope.alias("h"))
    return base64url(F.to_json(parts, {"ignoreNullFields": "false"}))


def read_share_code(code: Column, templates: tuple[str, ...]) -> Column:
    """The decoded card, or null where the code is malformed or its name is blank."""
    plain = F.translate(code, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    raw = F.try_to_binary(padded, F.lit("base64"))
    card = F.from_json(F.decode(raw, "UTF-8"), "n string, d string, b string, t string, h boolean")
    name = F.substring(trimmed(card["n"]), 1, 60)
    made = F.struct(
        name.alias("name"),
        card["d"].alias("birth_date"),
        F.substring(card["b"], 1, 280).alias("bio"),
        F.when(card["t"].isin(*templates), card["t"]).otherwise("classic").alias("template"),
        F.coalesce(card["h"], F.lit(False)).alias("horoscope"),
    )
    return F.when(F.length(name) > 0, made)


def uri_component(x: Column) -> Column:
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for plain, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def zodiac(day: Column) -> Column:
    """The sign of a date, null for none."""
    key = F.month(day) * 100 + F.day(day)
    out = F.lit(None).cast("string")
    for last, sign in reversed(SIGNS):
        out = F.when(key <= last, F.lit(sign)).otherwise(out)
    return F.when(day.isNotNull(), out)


def age_years(day: Column, year: Column, as_of: Column) -> Column:
    """Whole years from a birth date, else from a birth year; null for a date to come."""
    full = F.year(as_of) - F.year(day) - F.when(F.date_format(as_of, "MMdd") < F.date_format(day, "MMdd"), 1).otherwise(0)
    return F.when(day.isNotNull(), F.when(full >= 0, full)).when(year.isNotNull(), F.greatest(F.lit(0), F.year(as_of) - year))


def sign_mark(sign: Column) -> Column:
    """The symbol of a sign: they follow each other from Aries on."""
    at = F.array_position(F.array(*[F.lit(s) for s in ZODIAC]), sign)
    return F.when(at > 0, F.element_at(F.array(*[F.lit(chr(0x2648 + i)) for i in range(12)]), at.cast("int")))


def approximate_age(year: Column, as_of: Column) -> Column:
    """The difference of years, also of a year to come."""
    return F.year(as_of) - year


#: What crawlers are kept from.
DISALLOWED = ("/api/", "/*/analyze", "/*/cats", "/*/history", "/*/medical", "/*/cards", "/*/admin")


def disallowed(path: Column, rules: tuple[str, ...] = DISALLOWED) -> Column:
    """Whether a rule is the head of ``path``; a star in a rule stands for anything."""
    patterns = ["^" + ".*".join(f"\\Q{p}\\E" for p in rule.split("*")) for rule in rules]
    return path.rlike("|".join(patterns))


def manifest(body: Column) -> Column:
    """What a model's manifest says, null if it is no JSON."""
    return F.from_json(body, "schemaVersion int, kind string, version string, classes array<string>")


def accepted(m: Column) -> Column:
    """Whether a manifest keeps the contract."""
    return F.coalesce((m["schemaVersion"] == 2) & (m["kind"] == "waveform"), F.lit(False))


def is_microchip(x: Column) -> Column:
    return x.rlike(r"^[0-9]{15}\z")


def draft_error(name: Column, year: Column, day: Column, chip: Column, bio: Column, as_of: Column) -> Column:
    """The first thing that is wrong with a profile draft, or null."""
    n, d, c = trimmed(name), F.nullif(trimmed(day), F.lit("")), F.nullif(trimmed(chip), F.lit(""))
    parsed = F.try_to_date(d, "yyyy-MM-dd")
    wrong_day = parsed.isNull() | (F.year(parsed) < 1985) | (parsed > as_of)
    return (
        F.when(F.coalesce(F.length(n), F.lit(0)) == 0, "cat/name-required")
        .when(F.length(n) > 60, "cat/name-too-long")
        .when(year.isNotNull() & ((year < 1985) | (year > F.year(as_of))), "cat/invalid-birth-year")
        .when(d.isNotNull() & wrong_day, "cat/invalid-birth-date")
        .when(c.isNotNull() & ~is_microchip(c), "cat/invalid-microchip")
        .when(F.length(bio) > 280, "cat/bio-too-long")
    )


def fitted(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Dimensions scaled down to at most ``most``, never up, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("long")
    return side(width), side(height)
