"""Checks of JSON payloads: the path of the first field that breaks the contract, or null.

Payloads are parsed to variants, so a number given as a string, a null and a missing field
are told apart.  Text that is not JSON, or not an object, breaks the contract at ``$``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocalith.functions.scoring import CLASSES, UNKNOWN

# Names, enumerations and limits of the contracts.
FEATURES = ("durationS", "rms", "f0RangeHz", "voicedRatio", "spectralCentroidHz", "spectralFlatness", "zeroCrossingRate", "amStrength")
NULLABLE_FEATURES = ("f0Hz", "f0StartHz", "f0EndHz", "amRateHz")
VERDICTS = ("correct", "partially-correct", "incorrect")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


class Fields:
    """Predicates on the fields of a variant; each is never null."""

    def __init__(self, v: Column, prefix: str = "$") -> None:
        self.v, self.prefix, self.found = v, prefix, []

    def _at(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.v, f"{self.prefix}.{path}", kind)

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(self._at(path, "variant")), F.lit("missing"))

    def is_object(self, path: str = "") -> Column:
        """Told without a schema, for which all that the object holds would be gone through."""
        return F.try_variant_get(self.v, f"{self.prefix}{path and '.'}{path}", "map<string,variant>").isNotNull()

    def need(self, path: str, fine: Column, optional: bool = False, nullable: bool = False) -> None:
        kind = self.kind(path)
        if optional:
            fine = fine | (kind == "missing")
        if nullable:
            fine = fine | (kind == "VOID")
        self.found.append(F.when(~F.coalesce(fine, F.lit(False)), F.lit(f"{self.prefix}.{path}")))

    def number(self, path: str, low: float | None = None, high: float | None = None, whole: bool = False, **how: bool) -> None:
        kind, value = self.kind(path), self._at(path, "double")
        fine = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        for bad in ([value < low] if low is not None else []) + ([value > high] if high is not None else []) + ([value != F.floor(value)] if whole else []):
            fine = fine & ~bad
        self.need(path, fine, **how)

    def text(self, path: str, least: int = 0, most: int | None = None, among: tuple[str, ...] = (), like: str | None = None, **how: bool) -> None:
        value = self._at(path, "string")
        fine = (self.kind(path) == "STRING") & (F.length(value) >= least)
        if most is not None:
            fine = fine & (F.length(value) <= most)
        if among:
            fine = fine & value.isin(*among)
        if like is not None:
            fine = fine & value.rlike(like)
        self.need(path, fine, **how)

    def flag(self, path: str) -> None:
        self.need(path, self.kind(path) == "BOOLEAN")

    def items(self, path: str, check: object, most: int | None = None, **how: bool) -> None:
        """A list whose items ``check`` (which adds to the Fields of an item) finds no fault with."""
        value = self._at(path, "array<variant>")

        def fine(x: Column) -> Column:
            inner = Fields(x)
            check(inner)
            return inner.error().isNull()

        ok = value.isNotNull() & F.forall(value, fine)
        self.need(path, ok & (F.size(value) <= most) if most is not None else ok, **how)

    def error(self) -> Column:
        return F.coalesce(F.when(~self.is_object(), F.lit("$")), *self.found)


def _checked(payload: Column, check: Callable[[Fields], None]) -> Column:
    """The error that ``check`` finds in a payload, which is put together and parsed once and not again for each field."""

    def error(v: Column) -> Column:
        f = Fields(v)
        check(f)
        return f.error()

    return F.transform(F.array(F.try_parse_json(payload)), error)[0]


def _features(f: Fields, at: str = "") -> None:
    limits = {"durationS": {"low": 0}, "voicedRatio": {"low": 0, "high": 1}}
    for name in FEATURES:
        f.number(at + name, **limits.get(name, {}))
    for name in NULLABLE_FEATURES:
        f.number(at + name, nullable=True)


def features_error(payload: Column) -> Column:
    return _checked(payload, _features)


def _session(f: Fields) -> None:
    known = (*CLASSES, UNKNOWN)
    f.text("id", like=UUID)
    f.text("catId", like=UUID, nullable=True)
    f.number("createdAt", whole=True)
    f.text("source", among=("microphone", "file"))
    f.number("recordingDurationS", low=0)
    f.number("segment.startS", low=0)
    f.number("segment.endS", low=0)
    _features(f, "segment.features.")
    f.text("classification.primary.cls", among=known)
    f.number("classification.primary.probability", low=0, high=1)

    def alternative(x: Fields) -> None:
        x.text("cls", among=known)
        x.number("probability")

    f.items("classification.alternatives", alternative)
    f.text("classification.certainty", among=("high", "medium", "low"))
    f.flag("classification.ambiguous")
    f.text("classification.engineId")
    f.text("classification.modelVersion")


def session_error(payload: Column) -> Column:
    return _checked(payload, _session)


def _assistant(f: Fields) -> None:
    f.text("mode", among=("medical", "meow"))
    f.text("locale", among=("es", "en"))
    f.text("question", least=1, most=1000)
    f.need("context", f.is_object("context"))
    f.text("context.name", most=80, optional=True)
    f.text("context.breed", most=80, optional=True)
    f.number("context.ageYears", low=0, high=40, optional=True)

    def vaccine(x: Fields) -> None:
        x.text("name", most=80)
        x.text("status", most=40)
        x.text("date", most=40, optional=True)

    def note(x: Fields) -> None:
        x.text("kind", most=40)
        x.text("title", most=120)
        x.text("date", most=40, optional=True)

    def meow(x: Fields) -> None:
        x.text("cls", most=40)
        x.number("confidence", low=0, high=1)
        x.text("date", most=40, optional=True)

    for name, check, most in (("vaccines", vaccine, 30), ("records", note, 30), ("recentMeows", meow, 20)):
        f.items(f"context.{name}", check, most, optional=True)


def assistant_error(payload: Column) -> Column:
    return _checked(payload, _assistant)


def _feedback(f: Fields) -> None:
    f.text("sessionId", like=UUID)
    f.text("verdict", among=VERDICTS)
    f.text("predictedClass", least=1)
    f.text("correctedClass", nullable=True)
    f.flag("sharedForTraining")
    f.text("turnstileToken", least=1)


def feedback_error(payload: Column) -> Column:
    return _checked(payload, _feedback)


def allowed(addresses: Column) -> Column:
    """The addresses of a list separated by commas or white space, in lower case."""
    return F.filter(F.transform(F.split(F.coalesce(addresses, F.lit("")), r"[,\s]+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def is_admin(address: Column, addresses: Column) -> Column:
    return F.coalesce(F.array_contains(allowed(addresses), F.lower(address)), F.lit(False))


def registered(accounts_enabled: Column, authenticated: Column) -> Column:
    """Without accounts everybody counts as registered."""
    return F.when(accounts_enabled, authenticated).otherwise(F.lit(True))


# The message of each error code; all others are "errorGeneric".
MESSAGES = {
    "analysis/no-vocalization": "errorNoVocalization", "audio/too-long": "errorTooLong", "audio/too-short": "errorTooShort",
    "audio/decode-failed": "errorWrongFormat", "audio/resample-failed": "errorWrongFormat",
}


def error_message(code: Column) -> Column:
    out = F.lit("errorGeneric")
    for known, message in MESSAGES.items():
        out = F.when(code == known, F.lit(message)).otherwise(out)
    return out


def local_date(day: Column, locale: Column) -> Column:
    """A day as Spanish or (American) English writes it in numbers."""
    return F.when(locale == "es", F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))


def stable_uuid(*keys: Column) -> Column:
    """A version-4 id that the keys decide, so that a task that runs again gives the same."""
    h = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys]))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def phrase_seed(*keys: Column) -> Column:
    """A number below 100,000 that the keys decide."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 8), 16, 10).cast("long"), F.lit(100_000))
