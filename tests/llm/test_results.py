"""Results against brute force, the tokenizers library and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, language_id, packing, toxicity


def test_pieces_are_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", "\n", "é", "汉", "9", "'s", "　", "Word"]) for _ in range(rng.randint(0, 6000))) for _ in range(30)]
    texts += [" " * 1_000_000 + "x", "\n \t" * 100_000, "", None, "<|endoftext|> a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in packing.pieces(df, bpe.default_vocabulary()).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(got[i]) == want


def fewest_bins(sizes, capacity):
    """By trying every set of items that could share the next bin."""
    best = len(sizes)

    def put(left, free, used):
        nonlocal best
        if used + math.ceil(max(0, sum(left) - sum(free)) / capacity) >= best:
            return
        if not left:
            best = used
            return
        s, rest = left[0], left[1:]
        for f in sorted(set(x for x in free if x >= s)):
            k = free.index(f)
            put(rest, [*free[:k], f - s, *free[k + 1 :]], used)
        put(rest, [*free, capacity - s], used + 1)

    put(sorted(sizes, reverse=True), [], 0)
    return best


def test_bounds_never_exceed_the_fewest_bins(spark):
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        least = fewest_bins(sizes, 30)
        fill = packing.best_fit_decreasing(np.array(sizes), 30)[2]
        assert packing.lower_bound(np.bincount(sizes, minlength=31), 30) <= least <= len(fill) <= 11 / 9 * least + 1 and fill.max() <= 30
    rows = [(i, 0, 0, rng.randint(1, 700), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, target=40).toPandas()
    bound = packing.lower_bound(np.bincount([r[3] for r in rows], minlength=1025), 1024)
    assert len(out) == 400 and bound <= out["sequence_id"].nunique() <= bound + 10  # of 10 partitions, a bin each
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024


def posterior(model, pages, weight=language_id.WEIGHT):
    """(best, confidence) of each page, by adding up all other pages one by one."""
    langs = model.languages
    logs, soft, where = [], [], []
    for url, html in pages:
        host, domain, said = language_id.host_of(url)
        a = next((s for s in said if s in langs), None)
        z = model.text(language_id.visible(html)) + model.hint(language_id.declared_language(html), language_id.DECLARED) + model.hint(a, language_id.ADDRESSED)
        logs.append(z)
        soft.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        where.append((host, domain))
    out = []
    for i, (host, domain) in enumerate(where):
        others = [j for j in range(len(pages)) if j != i]
        add = lambda some: sum((soft[j] for j in some), np.zeros(len(langs)))
        p = (add(others) + 1) / (len(others) + len(langs))
        for some in ([j for j in others if where[j][1] == domain], [j for j in others if where[j][0] == host]):
            p = (add(some) + weight * p) / (len(some) + weight)
        z = logs[i] + np.log(p)
        out.append((langs[int(z.argmax())], 1 / np.exp(z - z.max()).sum()))
    return out


@pytest.mark.parametrize("small", [language_id.SMALL, 0])
def test_posteriors_are_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(language_id, "SMALL", small)
    rng = random.Random(3)
    model = language_id.TextModel([("the cat and the dog in this house", "en"), ("der hund und die katze in diesem haus", "de"), ("le chat et le chien dans la maison", "fr")])
    words = "the der le dog hund chien xyz".split()
    hosts = ["a.example.de", "b.example.de", "example.co.uk", "other.co.uk", "", "10.0.0.1"]
    pages = [(f"http://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'x'])}/", f"<html lang='{rng.choice(['de', 'fr', 'zz'])}'>{rng.choice(words)} {rng.choice(words)}") for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["lang"], r["confidence"]) for r in language_id.identify(df, model).collect()}
    for i, (lang, sure) in enumerate(posterior(model, pages)):
        assert got[i] == (lang, pytest.approx(sure))
    alone = spark.createDataFrame([(0, "http://x.org/", "der hund")], df.schema)
    assert language_id.identify(alone, model).collect()[0]["lang"] == "de"


def test_languages_of_the_pages(spark):
    sf = "/root/testdata/sf0.01"
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(language_id.visible(r["html"]), language_id.declared_language(r["html"])) for r in pages.collect()]
    assert language_id.accuracy(model, [r for r in rows if r[1] in model.languages]) >= 0.98  # of text alone
    out = language_id.identify(pages, model).where(F.col("declared").isin(model.languages))
    assert out.where("lang = declared").count() >= 0.98 * out.count()


def test_registered_domains():
    assert language_id.host_of("http://a.b.co.uk/")[1] == "b.co.uk" and language_id.host_of("http://a.b.example.com")[1] == "example.com"
    assert language_id.host_of("http://co.uk/")[1] == "co.uk" and language_id.host_of("http://10.1.2.3/x")[1] == "10.1.2.3"


def test_unclosed_markup_takes_one_pass():
    for html in ("<" * 1_000_000, "<script>" * 200_000, "<!--" * 300_000 + ">", "<html " * 200_000, "<style>" * 100_000 + "</style >x"):
        language_id.visible(html)
        language_id.declared_language(html)
    assert language_id.visible("a<script>b</script>c<!-- d -->e<p>f<g") == "a c e f<g"
    assert language_id.declared_language("<html><HTML class=x LANG = 'de-CH'>") == "de"


def test_noisy_or_likelihood_falls_along_its_slope():
    """The trained weights are near a minimum of the penalised likelihood, computed here sentence by sentence."""
    rng = random.Random(4)
    words = "red green blue pink grey gold".split()
    rows = []
    for k in range(120):
        parts = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randint(1, 4))]
        if k % 2:
            parts[rng.randrange(len(parts))] += " nasty"
        rows.append((". ".join(parts), k % 2))
    model = toxicity.train(rows, sparse=0.0)

    def loss(weights, bias):
        total = 0.0
        for text, y in rows:
            none = 1.0
            for sentence in text.split("."):
                z = bias + sum(weights.get(f, 0.0) for w in set(sentence.split()) for f in set(toxicity.features(w)))
                none *= 1 - 1 / (1 + math.exp(-z))
            total -= math.log(max(1e-12, 1 - none if y else none))
        return total / len(rows)

    own = {f: w for f, w in model.weights.items() if math.isfinite(w)}
    here = loss(own, model.bias)
    for text, _ in rows[:20]:  # the model's own score is the noisy-or of its sentences
        none = 1.0
        for p in model.sentences(text):
            none *= 1 - p
        assert model.score(text) == pytest.approx(1 - none, abs=1e-9)
    assert here < 0.05 < loss({}, -4.0)
    assert loss({f: 0.9 * w for f, w in own.items()}, model.bias) > here


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.op5_toxicity(spark, sf).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").where("toxic is not null")
    r = out.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).collect()[0]
    assert df.count() and r["caught"] >= 0.8 and r["wrong"] <= 0.01
