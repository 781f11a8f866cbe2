"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables, for every operator and query."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyspark.llm import bpe, chat, embedding_dedup, language_id, line_dedup, ngram_join, packing, pii, queries, topk, toxicity

#: The extra columns have names that the operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, host string, line long, s long, n int, a long, b long, "
    "uid long, terms string, token long, root long, h long, score double, fill long, part long, seen string"
)
LONG = "word " * 30_000 + "x" * 200_000 + " me@mail.example.com"
TEXTS = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same id here"), (2, None), (3, ""), (4, " \n\t "),
         (5, LONG), (None, "one two three four five six"), (None, None), (6, "ONE two three four five six"), (7, "mail me@mail.example.com\n\nnow"), (8, "\x00é汉")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *[None] * 19) for i, t in TEXTS], SCHEMA)


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=str)


ALL = sorted((i for i, _ in TEXTS), key=str)


def test_rows_stay_and_columns_keep_their_names(spark, odd):
    model = toxicity.Model({".": float("inf"), "nasty": 9.0}, -4.0)
    assert ids(toxicity.score(odd, model)) == ids(pii.report(odd)) == ids(bpe.digest(odd, bpe.default_vocabulary())) == ALL
    for out in (toxicity.drop_toxic(odd, model), line_dedup.drop_lines(odd).drop("__removed"), pii.sanitise(odd)):
        assert out.columns == odd.columns and ids(out) == ALL
    assert "me@mail" not in "".join(r["text"] or "" for r in pii.sanitise(odd).select("text").collect())


def test_packing_takes_every_row(spark, odd):
    packed = packing.pack(packing.pieces(odd, bpe.default_vocabulary()))
    assert ids(packed.where("piece = 0")) == ALL
    rows = packed.toPandas()
    fills = rows.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 1024 and (rows[rows["doc_id"].isin([2, 3])]["length"] == 1).all()


def test_ngram_join_of_odd_rows(spark, odd):
    rows = ngram_join.join(odd).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == ALL
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert by[6, 2] == by[1, 2] == 1 and by[2, 0] == 2 and by[3, 0] == 3 and by[4, 0] == 4 and by[None, 2] is None
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and ids(kept) == sorted([1, 1, 2, 3, 4, 5, 7, 8, None, None], key=str)  # two texts of id 1


def test_vectors_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, None], 1), (3, [float("inf"), 1.0], 1), (4, [], 1), (5, None, 1), (6, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0], 1), (7, [1.0, 2.0], None), (8, [0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, uid long, id long, root long")
    out = {r["vec_id"]: r for r in embedding_dedup.dedup(df).collect()}
    assert embedding_dedup.dedup(df).count() >= len(rows) and out[1]["component_id"] == 0 and not out[1]["kept"] and out[1]["n_links"] == 2
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (2, 3, 4, 5, 6, 7, 8)) and out[None]["component_id"] is None
    v = spark.createDataFrame([(i, [1, 1]) for i in (0, 3, 1, 2)] + [(9, [1, 1, 1])], "id long, v array<long>")
    assert [r["id"] for r in topk.top_k(v, v.where("id = 0"), 2).orderBy("rank").collect()] == [1, 2]  # ties go to smaller ids


def test_finite_vectors_of_any_size_are_compared(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [2e-200, 4e-200]), (2, [1e200, 2e200]), (3, [1e308, 1e308]), (4, [5e-324, 5e-324]), (5, [-1e200, 2e200]), (6, [1e200, 1e-200]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(df).collect()}
    assert out == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_large_buckets_and_parts_decide_like_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((3, 12))
    v = np.concatenate([base[k] + 0.05 * rng.standard_normal((25, 12)) for k in range(3)] + [np.repeat(base[:1], 9, 0)])
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = []
    for small, part in ((16, 1024), (2, 1024), (2, 5), (64, 1024)):
        monkeypatch.setattr(embedding_dedup, "SMALL", small)
        monkeypatch.setattr(embedding_dedup, "PART", part)
        got.append(sorted(tuple(r) for r in embedding_dedup.dedup(df).collect()))
    assert got[0] == got[1] == got[2] == got[3] and sum(r[1] for r in got[0]) > 100


def test_scores_that_overflow_are_an_error(spark):
    big = spark.createDataFrame([(i, [2**40, i]) for i in range(3)], "id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big, big, 1).collect()
    wide = spark.createDataFrame([(i, [2**30 + i, -(2**30) + 3 * i]) for i in range(6)], "id long, v array<long>")
    vs = [(2**30 + i, -(2**30) + 3 * i) for i in range(6)]
    for r in topk.top_k(wide, wide, 2).collect():
        a, b = vs[r["query_id"]], vs[r["id"]]
        assert r["score"] == a[0] * b[0] + a[1] * b[1]


def test_chat_and_language_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None, "k"), (1, 0, "user", "", "k"), (1, 0, "user", "", "k"), (1, None, "assistant", "x" * 100_000, "k")], "conv_id long, turn long, role string, content string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(rows)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 100_000 and got[None]["n_turns"] == 1
    model = language_id.TextModel([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    pages = spark.createDataFrame([(None, None, None, "h"), (1, "http://[bad", "the dog", "h"), (1, "http://[bad", "the dog", "h"), (2, "", "<p>" * 50_000, "h")], "page_id long, url string, html string, host string")
    assert ids(language_id.identify(pages, model), "page_id") == sorted([None, 1, 1, 2], key=str)
    assert language_id.identify(pages, language_id.TextModel([])).count() == 0


def test_queries_of_empty_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "embeddings", "pages", "labels", "conversations"):
        schema: pa.Schema = pq.read_schema(os.path.join(sf, f"{name}.parquet"))
        pq.write_table(schema.empty_table(), tmp_path / f"{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op8_chat" else 0), name


def test_join_sql_is_the_join(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [f"a{i % 7} b c d e f g h i j k l m n o p q r{i % 3}" for i in range(40)] + ["", " ", None, "X y", "x Y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(ngram_join.SQL).fetchall()) == sorted(tuple(r) for r in ngram_join.join(df).collect())


def test_digests_of_nothing(odd):
    got = [r for r in bpe.digest(odd.where("doc_id = 2"), bpe.default_vocabulary()).collect()]
    assert got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == got[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
