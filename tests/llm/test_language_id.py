import math

import numpy as np
from pyspark.sql import functions as F

from tempora.llm import language_id as lid
from tempora.llm.common import table


def test_fusion_against_brute_force(spark):
    texts = {"en": ["the house of the king", "this is the thing"], "fr": ["la maison du roi", "le chat est la"]}
    labelled = spark.createDataFrame([(t, k) for k, v in texts.items() for t in v] * 3 + [(None, "en"), ("x", None), ("", "de")], "text string, lang string")
    model = lid.fit_text_model(labelled, "text", "lang")
    assert model.languages == ["en", "fr"]
    for k, v in texts.items():  # each text counts once
        counts = np.bincount(np.concatenate([lid.trigram_cells([t])[0] for t in v]), minlength=lid.CELLS) + lid.PSEUDO
        assert np.allclose(model.log[model.languages.index(k)], np.log(counts / counts.sum()), atol=1e-5)
    rows = [
        (1, "the thing of the house", "en", "a.example.com", 0), (2, "le roi du chat", "en", "a.example.com", 0), (3, "le roi du chat", "fr-FR", "b.example.com", 0),
        (4, None, "en", "a.example.com", 0), (5, "", None, None, 0), (6, "123 !!", "fr", "x", 0), (7, "la " * 50_000, None, "c.org", 0), (8, "chat", None, None, 0), (8, "chat", None, None, 0), (9, "зима и лето", None, None, 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, p int")
    got = sorted(lid.identify(df, model, declared="lang", host="host").collect(), key=lambda r: r.doc_id)
    assert [r.p for r in got] == [0] * len(rows)
    ll = model.likelihoods([t or "" for _, t, *_ in rows]).tolist()
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    lettered = [(r, soft(x)) for r, x in zip(rows, ll, strict=True) if any(map(str.isalpha, r[1] or ""))]
    count = lambda test: [sum(p[j] for r, p in lettered if test(r)) for j in (0, 1)]
    smooth = lambda own, parent: [(x + lid.STRENGTH * q) / (sum(own) + lid.STRENGTH) for x, q in zip(own, parent, strict=True)]
    base = smooth(count(lambda r: True), [0.5, 0.5])
    said = {d: count(lambda r, d=d: (r[2] or "")[:2] == d) for d in ("en", "fr")}
    for r, x, g in zip(rows, ll, got, strict=True):
        if not any(map(str.isalpha, r[1] or "")):
            assert (g.language, g.confidence, g.keep) == (None, 0.0, False)
            continue
        prior = base  # of the languages; the background has its own
        if r[3]:
            for test in (lambda s: s and s.split(".")[-1] == r[3].split(".")[-1], lambda s: s and s.split(".")[-2:] == r[3].split(".")[-2:], lambda s: s == r[3]):
                prior = smooth(count(lambda o, test=test: test(o[3])), prior)
        score = [a + math.log(p) for a, p in zip(x, [*[p * (1 - lid.UNKNOWN) for p in prior], lid.UNKNOWN], strict=True)]
        if r[2]:
            score = [s + math.log((said[r[2][:2]][j] + 1) / (said["en"][j] + said["fr"][j] + 2) if j < 2 else 0.5) for j, s in enumerate(score)]
        post = soft(score)
        assert abs(g.confidence - max(post[:2])) < 1e-6 and g.language == ("en", "fr", None)[post.index(max(post))]
    assert lid.identify(df.limit(0), model, declared="lang", host="host").count() == 0
    assert {r.keep for r in lid.identify(df, lid.TextModel([], np.zeros((0, lid.CELLS), np.float32)), declared="lang").collect()} == {False}


def test_held_out_accuracy_and_clean_rows_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = lid.fit_text_model(docs.where("doc_id % 2 = 0"), "text", "lang", sample=300)
    out = lid.identify(docs.where("doc_id % 2 = 1").withColumn("was", F.col("lang")), model, declared=None, host="source")
    n, right = out.count(), out.where("language = was").count()
    assert right >= 0.97 * n
    kept = lid.query(spark, "/root/testdata/sf0.001")
    assert kept.where("doc_id IS NOT NULL AND NOT keep").count() <= 0.03 * kept.where("doc_id IS NOT NULL").count()
    assert kept.where("page_id IS NOT NULL AND language = declared_language").count() >= 0.9 * kept.where("page_id IS NOT NULL").count()


def test_names_that_clash_and_texts_of_no_language(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = lid.fit_text_model(docs, "text", "lang")
    strange = ["これは日本語の文章です。今日は天気がいいですね。", "Zażółć gęślą jaźń, a potem pójdźmy wszyscy razem do lasu", "xqzv wkjq zzxq vvkq jqxz kkqw zxcv qwkz", "Привет, как дела? Сегодня хорошая погода"]
    df = spark.createDataFrame([(i, t, "en", True, "x") for i, t in enumerate(strange)], "doc_id long, text string, language string, keep boolean, row string")
    out = lid.identify(df, model)
    assert sorted(out.columns) == sorted(["doc_id", "text", "row", "language", "confidence", "declared_language", "keep"])
    assert [(r.language, r.keep, r.row) for r in out.collect()] == [(None, False, "x")] * len(strange)
    assert lid.identify(df, model, prefix="_").where("keep AND language = 'en' AND NOT _keep").count() == len(strange)


def test_hot_hosts_over_salted_priors(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = lid.fit_text_model(docs, "text", "lang")
    small = sorted(map(str, lid.identify(docs, model, host="source").drop("text").collect()))
    monkeypatch.setattr(lid, "SMALL_ROWS", 0)
    assert sorted(map(str, lid.identify(docs, model, host="source").drop("text").collect())) == small


def test_pages_without_ends_take_one_sweep():
    assert lid.without_tags("a<script>x</script >b<style>y</STYLE>c<b>d</b>e<") .split() == ["a", "b", "c", "d", "e<"]
    assert len(lid.without_tags("<script " * 200_000)) == 1_600_000 and len(lid.without_tags("<" * 1_000_000)) == 1_000_000


def test_labels_of_few_texts_stay(spark):
    """The cut by hashes goes by different texts: labels of a few texts keep them, however many rows repeat them."""
    rows = [(f"row {i} of a large label with its own words {i * 7919}", "en") for i in range(4000)] + [(f"text of label {k} {'xyz'[k % 3]}", f"l{k}") for k in range(10) for _ in range(2000)]
    model = lid.fit_text_model(spark.createDataFrame(rows, "text string, label string"), "text", "label")
    assert model.languages == ["en", *(f"l{k}" for k in range(10))]
