"""Small reference tables, in this library's own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocalith.functions.scoring import CLASSES

# Categories, requirement levels, flags, signs and their last days.
CATEGORY = {
    "feliz_contento": "wellbeing", "trinos": "wellbeing", "descansando": "wellbeing", "enfadado": "alert", "pelea": "alert",
    "advertencia": "alert", "dolor": "alert", "llamada_madre": "natural", "llamada_apareamiento": "natural", "atencion": "natural",
}
VACCINES = (
    ("fvrcp", "Three-in-one (FVRCP)", "core", "recommended", "recommended", "recommended"),
    ("rabies", "Rabies shot", "non-core", "legal_required", "legal_required", "recommended"),
    ("felv", "Leukemia (FeLV)", "non-core", "recommended", "recommended", "recommended"),
    ("chlamydia", "Chlamydia shot", "non-core", "optional", "optional", "optional"),
    ("bordetella", "Bordetella shot", "non-core", "optional", "optional", "optional"),
)
FLAGS = {
    "premium.enabled": False, "premium.multiCat": False, "premium.unlimitedHistory": False, "premium.export": False,
    "audioDonation.enabled": True, "engine.onnx": False, "accounts.enabled": False,
}
TOGGLEABLE = ("premium.enabled", "audioDonation.enabled")
SIGNS = (
    (119, "capricorn"), (218, "aquarius"), (320, "pisces"), (419, "aries"), (520, "taurus"), (620, "gemini"), (722, "cancer"),
    (822, "leo"), (922, "virgo"), (1022, "libra"), (1121, "scorpio"), (1221, "sagittarius"), (1231, "capricorn"),
)
LOCALES = ("es", "en")
TITLES = {
    "feliz_contento": ("Happy", "H"), "trinos": ("Trills", "T"), "enfadado": ("Cross", "X"), "pelea": ("Fighting", "F"), "llamada_madre": ("Calling mother", "M"),
    "llamada_apareamiento": ("Courting", "C"), "dolor": ("In pain", "P"), "descansando": ("At rest", "R"), "advertencia": ("Warning", "W"), "atencion": ("Wants company", "A"),
}
PHRASES = {c: tuple(f"{t} {i}" for i in range(1, 4 + len(c) % 2)) for c, (t, _) in TITLES.items()}


def vocalizations(spark: SparkSession) -> DataFrame:
    rows = [(c, c.replace("_", "-"), *TITLES[c], CATEGORY[c], list(PHRASES[c])) for c in CLASSES]
    return spark.createDataFrame(rows, "cls string, slug string, title string, mark string, category string, phrases array<string>")


def vaccines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VACCINES, "id string, name string, level string, eu string, us string, other string")


def flags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FLAGS.items()), "key string, enabled boolean")
