"""Language of web pages by fusing evidence.

The posterior of a page's language is, up to a factor, the product of

* the likelihood of its visible text under letter-trigram models, one for each language of
  the labelled documents, tempered to count as at most ``TEXT_EVIDENCE`` trigrams;
* the probability of the language its markup declares, given the language;
* the probability of its address suffix, given the language;
* the prior of its host, smoothed towards its domain's and that towards the whole table's.

The last three are learnt from the table itself: every page hands its text posterior to
grouped sums by declared language, suffix, domain and host, and what it reads back of its
host, domain, declaration and suffix leaves its own share out.

The trigram models come from about ``LANGUAGE_ROWS`` labelled documents of each language, so
that a rare one has the model it would have in a small table, and from the ``GRAMS`` most
frequent trigrams of each language; all others count together.  There is no limit to the
languages; a model holds at most 4 * ``GRAMS`` numbers for each.  Pages are read whole, in
time in proportion to their length.

Defined cases: a null html or url is empty; pages without text have a flat likelihood and
rest on the other evidence; a null page_id is kept; ties go to the language that sorts
first; repeated rows each count; without labelled documents the language is null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocalith.llm.common import settle, skew_join

LANGUAGE_ROWS = 5_000
GRAMS = 3_000
TEXT_EVIDENCE = 60
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
SMOOTH = 0.5


def visible(html: str) -> str:
    """The text outside of tags; a ``<`` that no ``>`` follows before the next ``<`` is text."""
    html = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", " ", html)
    # Numbers beyond all code points; the standard library refuses those of very many digits.
    return unescape(re.sub(r"&#[0-9]{8,};?", " ", re.sub(r"<[^<>]*>", " ", html)))


def grams(text: str) -> Counter:
    t = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    t = f" {t} " if t else ""
    return Counter(map("".join, zip(t, t[1:], t[2:], strict=False)))


@dataclass(frozen=True)
class Model:
    """log P(trigram | language): ``others`` for trigrams that have no entry in a language, and what entries add to it.

    The entries of trigram i are ``start[i]`` to ``start[i + 1]``.
    """

    languages: tuple[str, ...]
    grams: tuple[str, ...]
    start: np.ndarray
    language: np.ndarray
    adds: np.ndarray
    unseen: np.ndarray  # for trigrams with entries in other languages only
    others: np.ndarray  # for trigrams without entries

    def likelihood(self, text: str) -> np.ndarray:
        at, seen = self.index(), grams(text)
        total = sum(seen.values())
        if not total:
            return np.zeros(len(self.languages))
        known = [(at[g], n) for g, n in seen.items() if g in at]
        ll = self.unseen * sum(n for _, n in known) + self.others * (total - sum(n for _, n in known))
        if known:
            rows, n = np.array(known).T
            sizes = self.start[rows + 1] - self.start[rows]
            entries = np.repeat(self.start[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            ll = ll + np.bincount(self.language[entries], self.adds[entries] * np.repeat(n, sizes), len(self.languages))
        return (ll - ll.max()) * min(1.0, TEXT_EVIDENCE / total)

    def index(self) -> dict[str, int]:
        if "_at" not in self.__dict__:
            object.__setattr__(self, "_at", {g: i for i, g in enumerate(self.grams)})
        return self.__dict__["_at"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by.setdefault(lang, Counter()).update(grams(text.as_py()))
        for lang, c in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "gram", "n"])


def train(docs: DataFrame, language_rows: int = LANGUAGE_ROWS) -> Model | None:
    labelled = docs.where("lang is not null and text is not null")
    sizes = settle(labelled.groupBy("lang").agg(F.count("*").alias("rows")))
    share = F.least(F.lit(1.0), F.lit(float(language_rows)) / F.col("rows")) * float(1 << 53)
    mine = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)
    some = labelled.select("lang", "text", mine.alias("h")).join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where("h < share")
    sums = some.select("lang", "text").mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    sums = settle(sums.withColumn("r", best))
    totals = {r.lang: r.n for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(r.lang for r in sizes.collect()))  # a row for each label that there is
    if not languages:
        return None
    named = sums.where(F.col("r") <= GRAMS).select("gram").distinct()
    rows = sums.where(F.col("r") <= 4 * GRAMS).join(named, "gram").orderBy("gram", "lang").select("gram", "lang", "n").collect()  # at most 4 * GRAMS a language
    names = sorted({r.gram for r in rows})
    at, of = {g: i for i, g in enumerate(names)}, {x: i for i, x in enumerate(languages)}
    gram, lang = (np.array([d[r[c]] for r in rows], np.int64) for d, c in ((at, "gram"), (of, "lang")))
    n = np.array([r.n for r in rows], np.float64)
    total = np.array([totals.get(x, 0) for x in languages], np.float64)
    rest = total - np.bincount(lang, n, len(languages))  # all that has no entry counts with the others
    mass = np.log(total + SMOOTH * (len(names) + 1))
    order = np.argsort(gram, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(gram, minlength=len(names)))]
    adds = np.log((n + SMOOTH) / SMOOTH)[order]
    return Model(languages, tuple(names), start, lang[order], adds, np.log(SMOOTH) - mass, np.log(rest + SMOOTH) - mass)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -3)


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(df: DataFrame, keys: list[str], languages: int, out: str) -> DataFrame:
    """The summed text posteriors of each group, as an array, and its rows ``n``."""
    each = [F.sum(F.get("post", F.lit(i))).alias(f"_{i}") for i in range(languages)]
    rows = F.sum("n") if "n" in df.columns else F.count("*")
    return df.groupBy(*keys).agg(*each, rows.alias("n")).select(*keys, F.array(*[f"_{i}" for i in range(languages)]).alias(out), "n")


def identify(pages: DataFrame, model: Model | None) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, suffix and host of every page."""
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select("page_id", declared.alias("declared"), host_of(url).alias("host"), html.alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    if model is None:
        nothing = F.lit(None).cast("string")
        return rows.select("page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("posterior"), nothing.alias("text_lang"), "declared", F.substring_index("host", ".", -1).alias("suffix"), "host")
    n = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [model.likelihood(visible(t.as_py())).tolist() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(logs, pa.list_(pa.float64()))], ["page_id", "declared", "host", "logs"])

    made = rows.mapInArrow(run, f"page_id {kind}, declared string, host string, logs array<double>")
    weight = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x))
    made = made.withColumn("post", F.transform("logs", lambda x: F.exp(x) / weight))
    made = settle(made.withColumns({"suffix": F.substring_index("host", ".", -1), "domain": domain_of(F.col("host"))}))

    hosts = settle(_sums(made, ["host", "domain", "suffix"], n, "post"))
    whole = _sums(hosts.withColumn("one", F.lit(1)), ["one"], n, "of_all").select("of_all")
    by_declared = settle(_sums(made, ["declared"], n, "of_declared"))
    of_hosts = hosts.drop("n")  # a domain or suffix is met by each of its hosts once
    domains, suffixes = settle(_sums(of_hosts, ["domain"], n, "of_domain")), settle(_sums(of_hosts, ["suffix"], n, "of_suffix"))
    marks = by_declared.agg(F.count("*").alias("n_declared")).crossJoin(suffixes.agg(F.count("*").alias("n_suffix"))).crossJoin(whole)  # one row
    near = settle(skew_join(skew_join(hosts, domains, ["domain"]), suffixes, ["suffix"]).select("host", F.col("post").alias("of_host"), "of_domain", "of_suffix", "n"))
    df = skew_join(skew_join(made.drop("suffix", "domain"), near, ["host"]), by_declared, ["declared"]).withColumn("suffix", F.substring_index("host", ".", -1)).crossJoin(F.broadcast(marks))

    def share(counts: Column, own: Column, parent: Column | None, m: float) -> Column:
        """The smoothed shares of the languages without the page's own."""
        left = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        total = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
        parent = F.transform(own, lambda x: F.lit(1.0 / n)) if parent is None else parent
        return F.transform(F.array(F.struct(left.alias("l"), total.alias("t"))), lambda s: F.zip_with(s.l, parent, lambda c, p: (c + m * p) / (s.t + m)))[0]

    own = F.col("post")
    df = df.withColumn("p_all", share(F.col("of_all"), own, None, 1.0))
    df = df.withColumn("p_domain", share(F.col("of_domain"), own, F.col("p_all"), DOMAIN_WEIGHT))
    df = df.withColumn("p_host", share(F.col("of_host"), own, F.col("p_domain"), HOST_WEIGHT))

    def given(counts: str, kinds: str) -> Column:
        """log P(value | language): the value's count in each language against all of the language's."""
        alone = F.zip_with(F.col(counts), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        return F.zip_with(alone, F.zip_with("of_all", own, lambda c, o: F.greatest(c - o, F.lit(0.0))), lambda c, a: F.log((c + SMOOTH) / (a + F.lit(SMOOTH) * (F.col(kinds) + 1))))

    fused = _add(_add(F.col("logs"), F.transform("p_host", lambda p: F.log(p))), _add(given("of_declared", "n_declared"), given("of_suffix", "n_suffix")))
    df = df.select("page_id", "declared", "suffix", "host", "logs", fused.alias("fused"))
    names = F.array(*[F.lit(x) for x in model.languages])
    top = F.array_max("fused")
    best = F.get(names, (F.array_position("fused", top) - 1).cast("int"))
    text = F.get(names, (F.array_position("logs", F.array_max("logs")) - 1).cast("int"))
    total = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return df.select("page_id", best.alias("lang"), F.round(1 / total, 6).alias("posterior"), text.alias("text_lang"), "declared", "suffix", "host")
