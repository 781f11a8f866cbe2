import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pii


def documents(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def plain(texts):
    """entity, term: p, removed, by counting in Python."""
    n_t, inside, n_te, n_e = Counter(), Counter(), defaultdict(set), defaultdict(set)
    for t in set(texts):
        n_t.update(pii._TERM.findall(t.lower()))
        by = defaultdict(list)
        found = list(pii.contexts(t, pii.base_spans(t)))
        for e, _, _, term in found:
            by[e].append(term)
        inside.update((e, term) for e, _, term in {(e, a, term) for e, a, _, term in found})
        for e, terms in by.items():
            n_e[e].add(tuple(terms))
            for term in terms:
                n_te[e, term].add(tuple(terms))
    whole, out = sum(n_t.values()), {}

    def estimate(e, terms):
        p_e = len(n_e[e]) / whole
        n, outside = sum(len(n_te[e, w]) for w in terms if (e, w) in n_te), sum(n_t[w] for w in terms) - sum(inside[e, w] for w in terms)
        p = (n + pii.PRIOR * p_e) / (n + outside + pii.PRIOR)
        return p, math.log2(p / p_e) / -math.log2(p_e)

    for e, term in n_te:
        p, ratio = estimate(e, [term])
        if ratio > pii.DISCLOSURE:
            general = None
            if p < pii.REMOVE:
                for k in range(len(term) - 1, 0, -1):
                    if estimate(e, [w for w in n_t if w.startswith(term[:k])])[1] <= pii.DISCLOSURE:
                        general = term[:k]
                        break
            out[e, term] = (pytest.approx(p), general is None, general)
    return out


def marks(text, found):
    """start, end, label of everything that is masked in text."""
    base = pii.base_spans(text)
    who = {pii.entity(k, text[a:b]) for k, a, b in base}
    out = [(a, b, f"[{k.upper()}]") for k, a, b in base]
    for m in pii._TERM.finditer(text or "") if base else ():
        hits = [found[e, m[0].lower()] for e in who if (e, m[0].lower()) in found]
        if hits and not any(a < m.end() and m.start() < b for _, a, b in base):
            label = "[REDACTED]" if any(h[1] for h in hits) else f"[{min((h[2] for h in hits), key=len)}*]"
            out.append((m.start(), m.end(), label))
    return out


def test_terms_of_rare_entities_are_counted_on_the_tables(spark):
    df = documents(spark, "sf0.001")
    texts = [r["text"] for r in df.select("text").collect() if r["text"]]
    want = plain(texts)
    assert want and {(r["entity"], r["term"]): (r["p"], r["removed"], r["general"]) for r in pii.disclosing(df).collect()} == want
    assert pii.report(df).where(F.col("spans").rlike("(term|general):")).count() > 0


def test_copies_of_texts_and_passages_leave_the_estimate(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    who = [f"zanzibarian {some(30)} {some(12)} zanzibarian spy@mail.example.com {some(12)}" for _ in range(3)]
    rest = [some(60) for _ in range(40)]
    near = [f"{who[1][12:]} {w}" for w in words]  # the same context in other texts

    def found(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return {(r["entity"], r["term"]): r for r in pii.disclosing(df).collect()}["email:spy@mail.example.com", "zanzibarian"]

    once = found(who + rest)
    assert once["p"] == pytest.approx(3 / (3 + 3 + pii.PRIOR), rel=0.01)
    assert found(who + rest + who[:1] * 1000) == once
    assert found(who + rest + near)["p"] == pytest.approx(once["p"], rel=0.01)


def test_the_estimate_is_the_same_for_repeated_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{some(20)} zanzibarian{'' if k else 's'} spy@mail.example.com {some(9)}" for k in range(3)] + [some(40) for _ in range(30)]

    def found(rows):
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        return {(r["entity"], r["term"]): (pytest.approx(r["p"]), r["removed"], r["general"]) for r in pii.disclosing(df).collect()}

    once = found(texts)
    assert once == plain(texts) and once["email:spy@mail.example.com", "zanzibarian"][1]
    assert found(texts * 5) == once


def test_terms_are_sought_however_far_they_stand(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    gap = " 0" * 2_000 + " " + "1" * 500 + " "  # no terms
    texts = [f"{some(12)} zanzibarian {gap}spy@mail.example.com{gap} {some(3 + k)}" for k in range(4)]
    texts.append(f"Zanzibarian {some(60)} spy@mail.example.com {some(60)}")
    texts += [some(50) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("anzibarian" not in rows[k] and "[REDACTED]" in rows[k] for k in range(5)) and rows[10] == texts[10]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert "term:0:11" in spans[4] and spans[10] == ""
    dense = "a@b.co " * 20_000 + "word " * 20_000
    assert len(list(pii.contexts(dense, pii.base_spans(dense)))) <= 20_000 * 2 * pii.WIDTH


def test_generalised_terms_keep_a_beginning_that_tells_little(spark):
    df = documents(spark, "sf0.01")
    found = pii.disclosing(df).where("not removed").collect()
    assert found and all(r["term"].startswith(r["general"]) and len(r["general"]) < len(r["term"]) for r in found)


def test_very_long_terms_have_a_bounded_beginning(spark):
    long = "q" * 150_000
    texts = [f"{long}{c} {c}1@mail.example.com" for c in "xy"] + [f"{long}{c} other words here" for c in "xxyy"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short = "q" * pii.LETTERS
    found = {(r["entity"], r["term"], r["general"]) for r in pii.disclosing(df, disclosure=0.5).collect()}
    assert found == {(f"email:{c}1@mail.example.com", long + c, short) for c in "xy"}
    out = [r["text"] for r in pii.sanitise(df, disclosure=0.5).orderBy("doc_id").collect()]
    assert out == [f"[{short}*] [EMAIL]"] * 2 + texts[2:]
