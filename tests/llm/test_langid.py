import math
import re
import time
from collections import Counter, defaultdict

import pytest

from vocalith.llm import langid


def test_accuracy_and_fusion(spark):
    sf = "/root/testdata/sf0.1"
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    truth = {i: re.search(r"//[^/]+/(\w\w)/", u)[1] for i, u, _ in pages}
    # Every tenth page declares another language, every seventh has no text, every thirteenth no declaration.
    odd = []
    for i, u, h in pages:
        h = re.sub(r'lang="\w+"', 'lang="es"', h, count=1) if i % 10 == 0 else h
        h = re.sub(r"<body>.*", "", h, flags=re.S).replace("<title>", "<title><!--") + "-->" if i % 7 == 0 else h
        h = re.sub(r' lang="\w+"', "", h, count=1) if i % 13 == 0 else h
        odd.append((i, u, h))
    got = langid.identify(spark.createDataFrame(odd, "page_id long, url string, html string"), model).toPandas()
    assert sorted(got.page_id) == sorted(truth)
    right = (got.lang == got.page_id.map(truth)).mean()
    no_text = got[got.page_id % 7 == 0]
    print("accuracy", right, (no_text.lang == no_text.page_id.map(truth)).mean())
    assert right > 0.97 and ((got.posterior > 0) & (got.posterior <= 1)).all()
    with_text = got[got.page_id % 7 != 0]
    assert (with_text.lang == with_text.page_id.map(truth)).mean() > 0.995


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the and of the", "en"), (2, "der die das und", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ("de", "en")
    rows = [(1, None, None, "a"), (None, "https://h.example.de/x", "<html lang=de>und das", "a"), (3, "not a url", "<html>the the", "a"), (3, "not a url", "<html>the the", "a"), (5, "http://h.example.de:80/", "<p>" + "und " * 90_000, "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in langid.identify(pages, model).collect()}
    assert langid.identify(pages, model).count() == 5
    assert got[5].lang == "de" and got[5].host == "h.example.de" and got[5].suffix == "de" and got[3].text_lang == "en"
    assert {r.lang for r in langid.identify(pages, None).collect()} == {None}
    assert langid.identify(pages.limit(0), model).collect() == []
    assert langid.train(docs.limit(0)) is None


def test_visible():
    assert langid.visible("a<script>b</script><style>c</style><!-- d --><p class='e'>f &amp; g").split() == ["a", "f", "&", "g"]


def test_hostile_markup_takes_linear_time():
    start = time.perf_counter()
    for html in ("<" * 2_000_000, "<a" * 1_000_000, "<script>" * 200_000, "</script " * 200_000, "<!--" * 400_000, "&#" + "1" * 1_000_000 + ";x", "<p" + " " * 1_000_000):
        langid.visible(html)
    assert time.perf_counter() - start < 20
    assert langid.visible("a < b <p>c&#99999999999;d").split() == ["a", "<", "b", "c", "d"]


def test_hostile_pages(spark):
    model = langid.train(spark.createDataFrame([(1, "the and of", "en"), (2, "der die das", "de")], "doc_id long, text string, lang string"))
    rows = [(1, "http://" + "x" * 200_000 + "." + "y" * 100_000 + "/", "<html " * 200_000), (2, "http://" + "a." * 100_000, "<html lang" + " " * 300_000), (3, None, "&#" + "9" * 10_000 + ";")]
    got = langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3] and all(r.declared == "" for r in got)


def test_every_language_has_a_model_of_its_own(spark):
    """More languages than any list would hold, one of them with most rows."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 2
    docs = [(i, f"{word(i)} {word(i)}", f"l{i:03d}") for i in range(150)] + [(1000 + i, "common words", "hot") for i in range(3000)]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), language_rows=50)
    assert len(model.languages) == 151
    for i in range(150):
        assert model.languages[int(model.likelihood(word(i)).argmax())] == f"l{i:03d}"


DOCS = [(1, "the cat and the dog of the house", "en"), (2, "the end of the day and the night", "en"), (3, "der hund und die katze das haus", "de"), (4, "das ende der nacht und die zeit", "de"), (5, "le chat et la maison de la nuit", "fr")]
PAGES = [
    (1, "http://a.example.de/x", "<html lang=de>der hund"), (2, "http://a.example.de/y", "<html>the cat"), (3, "http://b.example.de/", "<html lang='de'>die nacht"),
    (4, "http://www.site.fr/", "la nuit"), (5, "http://www.site.fr/", ""), (6, "https://one.two.three.com:8080/", "<html lang=en>the house"), (7, None, None),
    (8, "http://a.example.de/z", "<html lang=EN>the the the end of das"), (8, "http://a.example.de/z", "<html lang=EN>the the the end of das"), (9, "http://localhost/", "zzz qqq"),
]


@pytest.mark.parametrize("cap", [1000, 5])
def test_posterior_by_brute_force(spark, monkeypatch, cap):
    monkeypatch.setattr(langid, "GRAMS", cap)
    names = sorted({x for _, _, x in DOCS})

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        t = " " + " ".join(t) + " " if t else ""
        return [t[i : i + 3] for i in range(len(t) - 2)]

    counts = {x: Counter(g for _, t, y in DOCS if x == y for g in grams(t)) for x in names}
    ranked = {x: sorted(c, key=lambda g: (-c[g], g)) for x, c in counts.items()}
    vocabulary = {g for x in names for g in ranked[x][:cap]}
    entries = {x: {g: counts[x][g] for g in ranked[x][: 4 * cap] if g in vocabulary} for x in names}

    def loglik(text):
        out = []
        for x in names:
            total = sum(counts[x].values()) + 0.5 * (len(vocabulary) + 1)
            other = sum(counts[x].values()) - sum(entries[x].values())
            out.append(sum(math.log(((entries[x].get(g, 0) if g in vocabulary else other) + 0.5) / total) for g in grams(text)))
        scale = min(1, 60 / len(grams(text))) if grams(text) else 1
        return [(v - max(out)) * scale for v in out]

    rows = []
    for i, url, html in PAGES:
        text = re.sub("<[^>]*>", " ", html or "")
        logs = loglik(text)
        e = [math.exp(v) for v in logs]
        host = re.sub(":.*", "", (url or "").split("//")[-1].split("/")[0])
        found = re.search("lang='?(\\w+)", html or "")
        rows.append({"id": i, "logs": logs, "post": [v / sum(e) for v in e], "host": host, "domain": ".".join(host.split(".")[-3:]), "suffix": host.split(".")[-1], "declared": found[1].lower() if found else ""})
    sums = {k: defaultdict(lambda: [0.0] * len(names)) for k in ("host", "domain", "suffix", "declared")}
    for r in rows:
        for k, of in sums.items():
            of[r[k]] = [a + b for a, b in zip(of[r[k]], r["post"], strict=True)]
    whole = [sum(r["post"][j] for r in rows) for j in range(len(names))]

    def share(c, own, parent, m):
        left = [max(a - b, 0) for a, b in zip(c, own, strict=True)]
        return [(a + m * p) / (sum(left) + m) for a, p in zip(left, parent, strict=True)]

    want = []
    for r in rows:
        p = share(whole, r["post"], [1 / len(names)] * len(names), 1)
        p = share(sums["domain"][r["domain"]], r["post"], p, 20)
        p = share(sums["host"][r["host"]], r["post"], p, 5)
        score = []
        for j in range(len(names)):
            all_of = max(whole[j] - r["post"][j], 0)
            given = [math.log((max(sums[k][r[k]][j] - r["post"][j], 0) + 0.5) / (all_of + 0.5 * (len(sums[k]) + 1))) for k in ("declared", "suffix")]
            score.append(r["logs"][j] + math.log(p[j]) + sum(given))
        best = max(range(len(names)), key=lambda j: (score[j], -j))
        want.append((r["id"], names[best], 1 / sum(math.exp(v - score[best]) for v in score)))

    model = langid.train(spark.createDataFrame(DOCS, "doc_id long, text string, lang string"))
    assert model.languages == tuple(names) and len(model.grams) == len(vocabulary)
    got = langid.identify(spark.createDataFrame(PAGES, "page_id long, url string, html string"), model).collect()
    for g, w in zip(sorted((r.page_id, r.lang, r.posterior) for r in got), sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=2e-6)
