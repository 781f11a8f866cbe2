import random
from collections import Counter

from pyspark.sql import functions as F
from test_llm import groups
from test_pii import marks, plain

import corpus_pipeline
from tallyspark.llm import toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOC)


def test_lines_on_a_few_percent_of_a_large_source_go(spark):
    pages = [("header\n" if i % 33 == 0 else "") + f"page {i}" + ("\nrare" if i < 4 else "") for i in range(400)]
    out = corpus_pipeline.drop_boilerplate(spark, docs(spark, pages), "")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert [rows[i]["text"] for i in range(400)] == [p.removeprefix("header\n") for p in pages]
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_decide_as_plain_python(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [("header\n" if i % 10 == 0 else "") + f"{some(30)}\n{some(10)}" for i in range(100)]
    clean += [f"{clean[1]} more", clean[2], f"{some(20)} zanzibarian a1@mail.example.com {some(9)}", f"{some(20)} 10.0.0.1 {some(9)}", "", None]
    toxic = [f"{some(8)}. {some(4)} nasty {some(3)}. {some(8)}" for _ in range(60)]
    before = docs(spark, clean + toxic)
    before.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i >= len(clean))) for i in range(len(clean + toxic)) if i < 100 or i >= len(clean)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)

    model = toxicity.train(toxicity.sample(before, spark.read.parquet(f"{sf}/labels.parquet")))
    kept = corpus_pipeline.reject_toxic(spark, before, sf)
    assert texts(kept) == {i: t for i, t in enumerate(clean + toxic) if model.score(t) < toxicity.THRESHOLD}
    assert set(range(len(clean))) <= set(texts(kept)) and len(texts(kept)) < len(clean) + 10

    some_docs = docs(spark, clean)
    pages = {t for t in clean if t is not None}
    seen = Counter(line.strip(" ") for t in pages for line in set(t.split("\n")) if line.strip(" "))
    gone = {line for line, n in seen.items() if n >= corpus_pipeline.LINE_LEAST and n > corpus_pipeline.LINE_RATIO * len(pages)}
    want = {i: t if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone) for i, t in enumerate(clean)}
    assert gone == {"header"} and texts(corpus_pipeline.drop_boilerplate(spark, some_docs, sf)) == want

    first = {i: clean[i] for i, (_, c) in enumerate(groups(clean)) if c == i}
    assert len(first) < len(clean) and texts(corpus_pipeline.drop_near_copies(spark, some_docs, sf)) == first

    found = plain([t for t in clean if t])
    want = {}
    for i, t in enumerate(clean):
        want[i] = t
        for a, b, name in sorted(set(marks(t, found)), reverse=True):
            want[i] = want[i][:a] + name + want[i][b:]
    out = corpus_pipeline.sanitise(spark, some_docs, sf)
    assert texts(out) == want and "*] [EMAIL]" in want[102] + want[102].replace("[REDACTED] [EMAIL]", "*] [EMAIL]") and "[IP]" in want[103]
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
