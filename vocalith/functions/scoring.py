"""Rule scores, distributions, priors and classifications as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes in output order, their thresholds for a trained model, and
# the rules.  A term is (weight, feature, low, high, softness); "up", "down" and "1-v" are
# the rising and falling contour and the unvoiced share.
CLASSES = (
    "feliz_contento", "trinos", "enfadado", "pelea", "llamada_madre",
    "llamada_apareamiento", "dolor", "descansando", "advertencia", "atencion",
)
UNKNOWN = "unknown"
MODEL_THRESHOLDS = {
    "feliz_contento": 0.67, "trinos": 0.59, "enfadado": 0.64, "pelea": 0.78, "llamada_madre": 0.85,
    "llamada_apareamiento": 0.89, "dolor": 0.2, "descansando": 0.2, "advertencia": 0.87, "atencion": 0.7,
}
FEATURES = ("d", "f", "f_start", "f_end", "g", "v", "c", "s", "am_rate", "am")
RULES = {
    "feliz_contento": "(0.28*R(v,0.45,1,0.3) + 0.22*R(f,250,650,200) + 0.18*R(d,0.3,3,1) + 0.18*R(c,500,3000,800) + 0.14*R(s,0,0.2,0.15)) * AM(0.4) * (1 - 0.6*R(v,0,0.3,0.3)) * (1 - 0.7*UP())",
    "trinos": "(0.35*R(d,0.1,0.8,0.3) + 0.25*R(g,100,600,150) + 0.15*R(f,350,900,200) + 0.15*R(v,0.5,1,0.3) + 0.1*R(s,0,0.15,0.1)) * (1 - 0.6*R(d,1.2,4,1.5))",
    "enfadado": "(0.3*R(f,50,280,150) + 0.2*R(v,0.4,1,0.3) + 0.2*R(c,0,1600,800) + 0.2*R(d,0.3,5,0.5) + 0.1*R(s,0,0.15,0.1)) * (1 - 0.5*R(f,400,1200,300)) * AM(0.5)",
    "pelea": "(0.3*R(g,250,800,150) + 0.2*R(f,300,900,200) + 0.2*R(s,0.1,0.5,0.15) + 0.15*R(v,0.3,0.7,0.3) + 0.15*R(d,0.3,3,1)) * (1 - 0.6*R(s,0,0.08,0.05)) * (1 - 0.4*R(v,0.8,1,0.15))",
    "llamada_madre": "(0.4*DOWN() + 0.2*R(f,250,650,200) + 0.15*R(v,0.5,1,0.3) + 0.1*R(d,0.3,2,0.8) + 0.15*R(s,0,0.2,0.15)) * (1 - 0.6*UP()) * AM(0.7)",
    "llamada_apareamiento": "(0.25*R(d,1.5,10,1) + 0.3*R(g,200,800,150) + 0.2*R(f,250,800,200) + 0.15*R(v,0.4,1,0.3)) * (1 - 0.6*R(d,0,0.8,0.4)) * greatest(0.15, 0.5*R(g,200,800,150) + 0.5*R(g,100,300,100))",
    "dolor": "(0.3*R(f,600,1200,200) + 0.2*R(v,0.5,1,0.3) + 0.2*R(d,0.3,3,0.8) + 0.15*R(g,100,600,100) + 0.15*R(s,0,0.25,0.15)) * (1 - 0.5*R(f,300,550,150))",
    "descansando": "(0.4*R(am_rate,18,42,12)*am + 0.25*R(c,0,700,400) + 0.2*R(d,1,10,0.8) + 0.15*(1 - 0.5*R(g,100,600,80))) * CASE WHEN R(am_rate,18,42,12)*am > 0.01 THEN 1 ELSE 0.3 END * (1 - 0.3*R(c,700,2000,400))",
    "advertencia": "(0.35*R(s,0.25,1,0.15) + 0.25*(1 - v) + 0.2*R(c,2000,8000,1200) + 0.1*R(d,0.2,2.5,1)) * (1 - 0.4*R(v,0.5,1,0.3))",
    "atencion": "(0.3*UP() + 0.2*R(f,300,700,200) + 0.2*R(v,0.5,1,0.3) + 0.1*R(s,0,0.15,0.1) + 0.1*R(d,0.3,2,0.8)) * (1 - 0.5*R(d,0,0.4,0.2)) * (1 - 0.4*DOWN()) * AM(0.6) * CASE WHEN f > 800 THEN 1 - 0.4*least(1.0, (f - 800)/400) ELSE 1 END",
}
TEMPERATURE = 4.5
LEAST_ALTERNATIVE = 0.05
HIGH, MEDIUM, MARGIN = 0.70, 0.45, 0.15

_NUMBER = r"(?<![\w.])(\d+(?:\.\d+)?)(?![\w.])"


def rule_sql(rule: str) -> str:
    """A rule in plain SQL, in doubles, for Spark and for other engines."""
    import re

    def member(m: re.Match) -> str:
        x, low, high, soft = m[1].split(",")
        inside = f"CASE WHEN {x} < {low} THEN 1 - ({low} - {x}) / {soft} ELSE 1 - ({x} - {high}) / {soft} END"
        return f"(CASE WHEN {x} IS NULL THEN 0 WHEN {x} BETWEEN {low} AND {high} THEN 1 ELSE greatest(0, {inside}) END)"

    contour = "(CASE WHEN f_start IS NULL OR f_end IS NULL OR g = 0 THEN 0 ELSE greatest(0, ({0} - {1}) / g) END)"
    sql = re.sub(r"R\(([^()]*)\)", member, rule)
    sql = sql.replace("UP()", contour.format("f_end", "f_start")).replace("DOWN()", contour.format("f_start", "f_end"))
    sql = re.sub(r"AM\(([^()]*)\)", r"(CASE WHEN am > 0.3 THEN \1 ELSE 1 END)", sql)
    return re.sub(_NUMBER, r"CAST(\1 AS DOUBLE)", sql)


def rule_scores() -> Column:
    """An array of the ten scores, over the columns named in ``FEATURES``."""
    return F.array(*[F.expr(rule_sql(RULES[c])) for c in CLASSES])


def score(cls: str, p: Column) -> Column:
    return F.struct(F.lit(cls).alias("cls"), p.alias("probability"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, and not again for each element that ``body`` goes over."""
    return F.transform(F.array(value), body)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def distribution(scores: Column) -> Column:
    """Softmax over the scores and ``unknown``, whose evidence is what the best score lacks of 1."""
    names = F.array(*[F.lit(c) for c in (*CLASSES, UNKNOWN)])

    def shares(s: Column) -> Column:
        lack = F.greatest(F.lit(0.08), 1 - F.array_max(s))
        e = F.concat(F.transform(s, lambda x: F.exp(TEMPERATURE * x)), F.array(F.exp(TEMPERATURE * lack)))
        return _bound(e, lambda v: _bound(F.struct(v.alias("e"), _sum(v).alias("t")), lambda b: F.transform(b.e, lambda x: x / b.t)))

    return F.zip_with(names, _bound(scores, shares), lambda n, p: F.struct(n.alias("cls"), p.alias("probability")))


def blend(dist: Column, alphas: Column) -> Column:
    """``dist`` weighted by the subject's priors: clamp(1 + (mean / uniform - 1) / 2, 0.5, 2), unknown as it is."""
    k = len(CLASSES)
    clamp = lambda f: F.least(F.lit(2.0), F.greatest(F.lit(0.5), f))
    factors = _bound(F.struct(alphas.alias("a"), _sum(alphas).alias("t")), lambda b: F.transform(b.a, lambda x: clamp(1 + 0.5 * (k * x / b.t - 1))))
    raised = F.zip_with(dist, F.concat(factors, F.array(F.lit(1.0))), lambda x, f: F.struct(x.cls.alias("cls"), (x.probability * f).alias("p")))
    mass = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x.p)

    def shares(r: Column) -> Column:
        return _bound(F.struct(r.alias("r"), mass(r).alias("m")), lambda b: F.transform(b.r, lambda x: F.struct(x.cls.alias("cls"), (x.p / F.when(b.m == 0, F.lit(1.0)).otherwise(b.m)).alias("probability"))))

    return _bound(raised, shares)


def ranked(dist: Column) -> Column:
    """The distribution by falling probability, NaN first and null last; ties, to 14 digits, keep the order of the classes."""
    keyed = F.transform(dist, lambda x, i: F.struct(F.round(x.probability * 1e14).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed, asc=False), lambda k: k.x)


def certainty(first: Column, second: Column) -> Column:
    wide = first - F.coalesce(second, F.lit(0.0)) >= MARGIN
    return F.when((first >= HIGH) & wide, "high").when(first >= MEDIUM, "medium").otherwise("low")


def classification(by_rank: Column) -> Column:
    """Primary, at most two alternatives, certainty and ambiguity of a ranked distribution."""
    first = F.coalesce(F.get(by_rank, F.lit(0)), score(UNKNOWN, F.lit(1.0)))
    p, q = first["probability"], F.get(by_rank, F.lit(1))["probability"]
    level = certainty(p, q)
    return F.struct(
        first.alias("primary"),
        F.filter(F.slice(by_rank, 2, 2), lambda x: x.probability >= LEAST_ALTERNATIVE).alias("alternatives"),
        level.alias("certainty"),
        ((level == "low") | (p - F.coalesce(q, F.lit(0.0)) < MARGIN)).alias("ambiguous"),
    )


def demote(c: Column, when: Column) -> Column:
    """Where ``when`` holds, unknown takes the primary's place and probability, and the primary leads the alternatives."""
    down = F.struct(
        score(UNKNOWN, c["primary"]["probability"]).alias("primary"),
        F.slice(F.concat(F.array(c["primary"]), c["alternatives"]), 1, 2).alias("alternatives"),
        F.lit("low").alias("certainty"),
        F.lit(True).alias("ambiguous"),
    )
    return F.when(when & (c["primary"]["cls"] != UNKNOWN), down).otherwise(c)


def unknown_policy(c: Column) -> Column:
    return demote(c, c["certainty"] == "low")


def model_thresholds(c: Column) -> Column:
    limit = F.lit(0.45)
    for cls, t in MODEL_THRESHOLDS.items():
        limit = F.when(c["primary"]["cls"] == cls, F.lit(t)).otherwise(limit)
    return demote(c, c["primary"]["probability"] < limit)
