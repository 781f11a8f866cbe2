import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, embedding_dedup, language_id, line_dedup, ngram_join, packing, pii, topk, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, id long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 0.5, 7) for i, t in enumerate(texts)], DOC)


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    base = [text(rng, rng.randint(1, 80)) for _ in range(40)]
    near = []
    for b in base:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near + base[:5] + [None, "", "   ", "one", "ONE", "x" * 5000, "a b c d", "<|endoftext|> mail me: Bob.x@mail.example.com or +1 (555) 123-4567"]


def test_bpe_is_the_library_s(spark, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(2)
    texts = corpus + ["".join(rng.choice("ab  'sre\n\t1²é汉\xa0٣") for _ in range(30)) for _ in range(200)]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    enc = bpe.Encoder(open(bpe.default_vocabulary(), "rb").read())
    assert enc.encode_batch(texts) == want
    got = {r["doc_id"]: r for r in bpe.digest(docs(spark, texts), bpe.default_vocabulary()).collect()}
    for i, ids in enumerate(want):
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(spark, texts), bpe.default_vocabulary()), bpe.default_vocabulary())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_packing_is_gapless_and_near_its_bound(spark, corpus):
    rng = random.Random(3)
    df = docs(spark, corpus + [text(rng, 1500)])
    p = packing.pieces(df, bpe.default_vocabulary())
    rows = packing.pack(p, target=64).toPandas()
    counts = np.bincount(rows["length"], minlength=1025)
    assert rows["sequence_id"].nunique() <= len(packing.best_fit_decreasing(rows["length"].to_numpy(), 1024)[2]) + 1
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 1024
    assert sorted(rows["doc_id"].unique()) == list(range(len(corpus) + 1))
    long = rows[rows["doc_id"] == len(corpus)].sort_values("piece")
    assert (long["length"].iloc[1:] == 1024).all() and (long["start"].diff().iloc[1:] == long["length"].shift().iloc[1:]).all()
    assert packing.pack(packing.pieces(df.where("1 = 0"), bpe.default_vocabulary())).count() == 0


def sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def groups(texts):
    s = sets(texts)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s[i]), find(i)) for i in range(len(s))]


@pytest.mark.parametrize("task", [6_000_000, 60])
def test_ngram_join_is_brute_force(spark, corpus, task, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK", task)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs(spark, corpus)).collect()}
    assert [got[i] for i in range(len(corpus))] == groups(corpus)
    kept = ngram_join.keep_first(docs(spark, corpus))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in groups(corpus)})
    assert ngram_join.join(docs(spark, [])).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii._luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans_are_the_patterns(spark):
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice(["a", "@", ".", "1", " ", "-", "+", "4111 1111 1111 1111", "10.0.0.1", "(", ")", "x.co", "+1555"]) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 50_000 + "." + "a" * 50_000) == []


def test_pii_masks_entities_and_what_discloses_them(spark):
    rng = random.Random(5)
    who = [f"{text(rng, 12)} {text(rng, k + 1)} zanzibarian spy@mail.example.com" for k in range(6)]
    plain = [text(rng, 40) for _ in range(60)]
    df = docs(spark, [*who, *plain, None, ""])
    found = pii.disclosing(df).collect()
    assert [r["term"] for r in found if r["removed"]] == ["zanzibarian"]
    out = pii.sanitise(df)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == df.columns and all("spy@" not in rows[k] and "zanzibarian" not in rows[k] and "[EMAIL]" in rows[k] for k in range(6))
    assert [rows[6 + k] for k in range(60)] == plain and rows[66] is None and rows[67] == ""
    rep = {r["doc_id"]: r for r in pii.report(df).collect()}
    assert rep[0]["n_email"] == 1 and "term:" in rep[0]["spans"] and rep[66]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.report(df.where("1 = 0")).count() == 0


def test_toxicity_learns_from_documents_and_locates(spark):
    rng = random.Random(6)
    rows = [(". ".join(text(rng, 8) for _ in range(6)), 0) for _ in range(60)]
    rows += [(". ".join([text(rng, 8), text(rng, 4) + " nasty " + text(rng, 3), text(rng, 8)]), 1) for _ in range(60)]
    model = toxicity.train(rows)
    right = [(model.score(t) >= 0.7) == bool(y) for t, y in rows]
    assert sum(right) >= 116
    t = "alpha1 beta2. gamma3 nasty delta4. eps5 zeta6."
    spans = model.locate(t)
    assert [t[a:b] for a, b, _ in spans] == [" gamma3 nasty delta4."]
    got = toxicity.score(docs(spark, [None, "", "...", t]), model).orderBy("doc_id").collect()
    assert [r["score"] for r in got[:3]] == [0.0, 0.0, 0.0] and got[3]["predicted"] == 1
    assert toxicity.drop_toxic(docs(spark, [None, "", t]), model).count() == 2
    assert toxicity.train([("a", 1)]).score("a") < 0.01


def test_line_dedup_by_host(spark):
    pages = [f"page {i}\nfooter \n\nonly {i}" for i in range(20)] + [None, "", "footer"]
    df = docs(spark, pages, "h").unionByName(docs(spark, ["footer\nx"], "other")).withColumn("host", F.lit("clash"))
    out = line_dedup.drop_lines(df).drop("__removed")
    rows = out.where("source = 'h'").orderBy("doc_id").collect()
    assert out.columns == df.columns and rows[0]["text"] == "page 0\n\nonly 0" and rows[20]["text"] is None and rows[21]["text"] == "" and rows[22]["text"] == ""
    assert out.where("source = 'other'").collect()[0]["text"] == "footer\nx"
    plan = line_dedup.drop_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    copies = docs(spark, ["same\nline"] * 50 + pages[:20], "h")
    assert line_dedup.drop_lines(copies).where("text = 'same\nline'").count() == 50


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16, "QUERY_BYTES": 100, "ROUND": 2, "TOGETHER": 2, "BINS": 3}])
def test_topk_is_brute_force(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(7)
    v = rng.integers(-9, 9, (120, 6))
    v[50:60] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    got = defaultdict(list)
    for r in topk.top_k(df, df.where("id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    for q in range(0, 120, 10):
        s = v @ v[q]
        assert got[q] == [(i, int(s[i])) for i in sorted((i for i in range(120) if i != q), key=lambda i: (-s[i], i))[:5]]
    few = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "id long, v array<long>")
    assert topk.top_k(few, few, 5).count() == 2
    assert topk.top_k(few.where("1 = 0"), few.where("1 = 0"), 5).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(8)
    for _ in range(5000):
        t = "".join(rng.choice(["\\", "<", "</s>", "[", "]", "[PART image 0 5]", "a", "\n", "[ROLE "]) for _ in range(rng.randint(0, 8)))
        formatted, found = chat.format_turn("a]\\", [{"type": "text", "text": t}, {"type": "image", "ref": "i", "width": 28, "height": 14}, {"type": "text", "text": t}])
        ((role, parts, learned),) = chat.read_turns(formatted)
        assert role == "a]\\" and not learned and [p for p in parts if isinstance(p, str)] == ([t, t] if t else []) and found[0].tokens == 2
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    rows = spark.createDataFrame([(1, 1, "assistant", "hé</s>"), (1, 0, "user", None), (None, 0, None, "x")], "conv_id long, turn long, role string, content string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(rows)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nhé</s>\n".encode()).hexdigest() and got[1]["loss_chars"] == 6 and got[None]["n_turns"] == 1
    typed = spark.createDataFrame([(1, 0, "user", ['{"type":"text","text":"see"}', '{"type":"audio","ref":"r","seconds":2}'])], "conv_id long, turn long, role string, content array<string>")
    assert chat.digest(chat.format_turns(typed)).collect()[0]["attachment_tokens"] == 50


def test_embedding_links(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 16))
    v = np.concatenate([base, base[:30] + 0.03 * rng.standard_normal((30, 16)), np.repeat(base[:1], 8, 0)])
    rows = [(i, x.tolist(), i % 60 % 3) for i, x in enumerate(v)] + [(200, None, 0), (201, [float("nan")] * 16, 0), (202, [0.0] * 16, 0), (203, base[0].tolist(), None)]
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98) & (np.array([r[2] for r in rows[:98]])[:, None] == np.array([r[2] for r in rows[:98]])[None, :])
    np.fill_diagonal(want, False)
    found = sum(got[i]["n_links"] for i in range(98))
    assert all(got[i]["n_links"] <= want[i].sum() for i in range(98)) and found >= 0.9 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203)) and len(got) == 102
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_language_evidence(spark):
    en, de = "the cat and the dog in this house with that", "der hund und die katze in diesem haus mit dem"
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de")] * 5)], "doc_id long, text string, lang string")
    model = language_id.fit(d)
    pages = [(0, "http://a.example.de/x", f"<html lang='en'><p>{de}</p>"), (1, "http://b.example.com/en/1", f"<html><script>{de}</script>{en}"), (2, None, None), (3, "http://a.example.de/", "")]
    got = {r["page_id"]: r for r in language_id.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert got[0]["lang"] == "de" and got[1]["lang"] == "en" and got[3]["lang"] == "de" and len(got) == 4 and got[2]["text_lang"] is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, sf)
        assert after.columns == before.columns and stage(spark, before.where("1 = 0"), sf).count() == 0
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() <= before.count()
