"""Payloads that are right or have one fault, and where each breaks its contract."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from vocalith.functions import contracts as C

ID = "12345678-9abc-4def-8123-456789abcdef"
GOOD_FEATURES = {
    "durationS": 0.6, "rms": 0.3, "f0Hz": 500, "f0StartHz": 420.5, "f0EndHz": None, "f0RangeHz": 160, "voicedRatio": 0.85, "spectralCentroidHz": 1800,
    "spectralFlatness": 0.04, "zeroCrossingRate": 1200, "amRateHz": None, "amStrength": 0,
}
GOOD_SESSION = {
    "id": ID, "catId": None, "createdAt": 1700000000000, "source": "file", "recordingDurationS": 2.5, "segment": {"startS": 0, "endS": 1.5, "features": GOOD_FEATURES},
    "classification": {"primary": {"cls": "dolor", "probability": 0.7}, "alternatives": [{"cls": "unknown", "probability": 0.2}], "certainty": "high", "ambiguous": False, "engineId": "rules", "modelVersion": "1"},
}
GOOD_QUESTION = {
    "mode": "meow", "locale": "en", "question": "Why?",
    "context": {"name": "Tom", "ageYears": 3, "vaccines": [{"name": "rabies", "status": "done"}], "records": [], "recentMeows": [{"cls": "dolor", "confidence": 1, "date": "2024-01-01"}]},
}
GOOD_FEEDBACK = {"sessionId": ID, "verdict": "incorrect", "predictedClass": "dolor", "correctedClass": None, "sharedForTraining": True, "turnstileToken": "t"}
GONE = object()


def _with(good: dict, path: str, value: object) -> str:
    """``good`` as JSON, with another value, or none, at ``path``."""
    made = copy.deepcopy(good)
    *way, last = path.split(".")
    at = made
    for step in way:
        at = at[step]
    if value is GONE:
        del at[last]
    else:
        at[last] = value
    return json.dumps(made)


#: For each contract its payloads and where each breaks it.
FEATURE_CASES = [
    (json.dumps(GOOD_FEATURES), None), ("not json", "$"), ("[1]", "$"), (_with(GOOD_FEATURES, "durationS", -1), "$.durationS"), (_with(GOOD_FEATURES, "rms", None), "$.rms"),
    (_with(GOOD_FEATURES, "rms", "0.3"), "$.rms"), (_with(GOOD_FEATURES, "voicedRatio", 1.01), "$.voicedRatio"), (_with(GOOD_FEATURES, "voicedRatio", 1), None), (_with(GOOD_FEATURES, "f0Hz", "500"), "$.f0Hz"),
    (_with(GOOD_FEATURES, "amRateHz", GONE), "$.amRateHz"), (_with(GOOD_FEATURES, "amStrength", float("nan")), "$"), (_with(GOOD_FEATURES, "extra", "is let be"), None),
]
SESSION_CASES = [
    (json.dumps(GOOD_SESSION), None), (_with(GOOD_SESSION, "id", "x" + ID), "$.id"), (_with(GOOD_SESSION, "catId", ID.upper()), None), (_with(GOOD_SESSION, "catId", GONE), "$.catId"),
    (_with(GOOD_SESSION, "createdAt", 1.5), "$.createdAt"), (_with(GOOD_SESSION, "createdAt", 2.0), None), (_with(GOOD_SESSION, "source", "radio"), "$.source"), (_with(GOOD_SESSION, "segment.startS", -0.1), "$.segment.startS"),
    (_with(GOOD_SESSION, "segment.features.rms", GONE), "$.segment.features.rms"), (_with(GOOD_SESSION, "classification.primary.cls", "purr"), "$.classification.primary.cls"),
    (_with(GOOD_SESSION, "classification.primary.probability", 2), "$.classification.primary.probability"), (_with(GOOD_SESSION, "classification.alternatives", [{"cls": "dolor"}]), "$.classification.alternatives"),
    (_with(GOOD_SESSION, "classification.alternatives", []), None), (_with(GOOD_SESSION, "classification.certainty", "sure"), "$.classification.certainty"), (_with(GOOD_SESSION, "classification.ambiguous", 0), "$.classification.ambiguous"),
    (_with(GOOD_SESSION, "classification.engineId", GONE), "$.classification.engineId"),
]
QUESTION_CASES = [
    (json.dumps(GOOD_QUESTION), None), (_with(GOOD_QUESTION, "mode", "law"), "$.mode"), (_with(GOOD_QUESTION, "locale", "fr"), "$.locale"), (_with(GOOD_QUESTION, "question", ""), "$.question"),
    (_with(GOOD_QUESTION, "question", "q" * 1001), "$.question"), (_with(GOOD_QUESTION, "question", "q" * 1000), None), (_with(GOOD_QUESTION, "context", GONE), "$.context"), (_with(GOOD_QUESTION, "context", {}), None),
    (_with(GOOD_QUESTION, "context.name", "n" * 81), "$.context.name"), (_with(GOOD_QUESTION, "context.name", None), "$.context.name"), (_with(GOOD_QUESTION, "context.ageYears", 41), "$.context.ageYears"),
    (_with(GOOD_QUESTION, "context.vaccines", [{"name": "a", "status": "b"}] * 31), "$.context.vaccines"), (_with(GOOD_QUESTION, "context.vaccines", [{"name": "a", "status": "b"}] * 30), None),
    (_with(GOOD_QUESTION, "context.records", [{"kind": "a", "title": "t" * 121}]), "$.context.records"), (_with(GOOD_QUESTION, "context.recentMeows", [{"cls": "a", "confidence": 1.5}]), "$.context.recentMeows"),
]
FEEDBACK_CASES = [
    (json.dumps(GOOD_FEEDBACK), None), (_with(GOOD_FEEDBACK, "sessionId", "1"), "$.sessionId"), (_with(GOOD_FEEDBACK, "verdict", "maybe"), "$.verdict"), (_with(GOOD_FEEDBACK, "predictedClass", ""), "$.predictedClass"),
    (_with(GOOD_FEEDBACK, "correctedClass", "pelea"), None), (_with(GOOD_FEEDBACK, "correctedClass", GONE), "$.correctedClass"), (_with(GOOD_FEEDBACK, "sharedForTraining", "yes"), "$.sharedForTraining"),
    (_with(GOOD_FEEDBACK, "turnstileToken", ""), "$.turnstileToken"), ("{}", "$.sessionId"),
]


@pytest.mark.parametrize("cases,error", [(FEATURE_CASES, C.features_error), (SESSION_CASES, C.session_error), (QUESTION_CASES, C.assistant_error), (FEEDBACK_CASES, C.feedback_error)], ids=["features", "session", "assistant", "feedback"])
def test_first_fault(spark, cases, error):
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = {r.i: r.e for r in rows.select("i", error(F.col("p")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_payloads_are_parsed_once(spark):
    """However many fields are checked; and objects are told without the schema of all that they hold."""
    rows = spark.createDataFrame([("{}",)], "payload string")
    for check in (C.features_error, C.session_error, C.assistant_error, C.feedback_error):
        plan = rows.select(check(F.col("payload")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") == 1
    bad = spark.createDataFrame([("[]",), ("3",), (None,), ("{",), ("null",)], "payload string")
    assert {r.e for r in bad.select(C.assistant_error(F.col("payload")).alias("e")).collect()} == {"$"}
    odd = [("[]", "$.context"), ("null", "$.context"), ("{}", None), ('{"vaccines": {}}', "$.context.vaccines"), ('{"vaccines": [3]}', "$.context.vaccines"), ('{"vaccines": null}', "$.context.vaccines"), ('{"vaccines": []}', None)]
    made = spark.createDataFrame([('{"mode": "meow", "locale": "en", "question": "q", "context": ' + x + "}", w) for x, w in odd], "payload string, want string")
    assert [(r.e, r.want) for r in made.select(C.assistant_error(F.col("payload")).alias("e"), "want").collect() if r.e != r.want] == []
