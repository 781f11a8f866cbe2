"""Exact top-k search by distributed histogram selection.

All candidates are scored against all queries in blocks. A first pass finds each query's range of scores; then
the score axis is cut into BINS bins and a histogram of all scores is summed, which tells in which bin the kth
value lies; that bin is cut again, until it is one score wide. With each query's kth value known, a last pass
keeps scores above it and, of those that tie with it, the smallest ids; ranks are dealt out at the end.

Candidates are gathered into blocks once and stay where they are. Queries come to them in rounds of at most ROUND
blocks of queries, which are broadcast (ROUND * QUERY_BYTES bytes at most); a task adds up one histogram for each
query of the round over all of its candidate blocks before it hands it on, so that what moves in a pass is BINS
counts for each query and task, and no list of candidates is gathered before the kth value is known. A round's
ranges are kept by the driver, a few numbers for each of its queries. The first pass also gives a score that k
candidates of one task reach, so that histograms begin there. A task holds at most SCORES scores at a time,
whatever the number of queries.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of
other lengths than a query's are no candidates of it; a query with fewer than k candidates returns all; rows
with a null id take no part; repeated ids are candidates each, but never of a query of their own id; of several
queries with one id, that with the smallest components is asked; components or scores that a 64-bit whole number
can't hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, ship, table

BINS = 64
#: Vectors and bytes in a block of candidates; bytes of a block of queries and blocks of a round.
BLOCK, BLOCK_BYTES, QUERY_BYTES, ROUND = 8192, 1 << 22, 1 << 18, 16
#: Scores that a task holds at a time (one query's of a block, if that has more vectors).
SCORES = 1 << 20
#: Stands for the score of a query with its own id; no score is so small.
LEAST = np.iinfo(np.int64).min
#: Queries whose histograms move as one row.
TOGETHER = 64


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """name, dim, ids, data: vectors (id, v: array<long>) gathered into blocks of about `rows` (or BLOCK_BYTES) of one length."""
    n = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.lit(1), F.col("dim"))))))
    n = n.select("dim", F.ceil(F.col("n") / each).cast("long").alias("parts"))
    keyed = vectors.withColumn("dim", F.size("v")).join(F.broadcast(n), "dim") if n.count() <= 1000 else vectors.withColumn("dim", F.size("v")).join(n, "dim")
    keyed = keyed.withColumn(name, F.pmod(F.xxhash64("id"), F.col("parts")))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        data = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), key[0])
        return pd.DataFrame({"dim": [key[0]], name: [key[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()]})

    return keyed.groupBy("dim", name).applyInPandas(gather, f"dim int, {name} long, ids binary, data binary")


def kind(q: np.ndarray, c: np.ndarray) -> type:
    """The numbers in which all inner products of these vectors, and all sums on the way to them, are exact."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * c.shape[1]
    if most >= 2**63:
        raise OverflowError("scores of these vectors don't fit 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def level(values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whole numbers as a column to compare scores with: what lies beyond the scores' kind is as good as its end."""
    end = {np.dtype(np.float32): 2**24, np.dtype(np.float64): 2**53}.get(like.dtype)
    return (values if end is None else np.clip(values, -end, end).astype(like.dtype))[:, None]


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true, in order; eight at a time are passed over."""
    flat = mask.ravel()
    full = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:full].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], full + np.flatnonzero(flat[full:])])
    return np.divmod(at, mask.shape[1])


def _round(base: DataFrame, dim: int, asked: list, k: int) -> DataFrame:
    """query_id, id, score: the k best of each query of a round, and more that tie with the kth. asked: rows of query blocks."""
    sc = base.sparkSession.sparkContext
    qid = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in asked])
    vectors = np.concatenate([np.frombuffer(r["data"], np.int64).reshape(-1, dim) for r in asked])
    queries = sc.broadcast((qid, vectors))  # ROUND * QUERY_BYTES at most
    here = base.where(F.col("dim") == dim)
    size = len(qid)

    def scored(it: Iterator[pd.DataFrame], of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]]:
        """Some of the queries `of`, ids of a block, their scores, and where a query meets its own id; SCORES at a time."""
        qid, q = queries.value
        qid, q, cast = qid[of], q[of], {}
        for pdf in it:
            for row in pdf.itertuples():
                ids, c = np.frombuffer(row.ids, np.int64), np.frombuffer(row.data, np.int64).reshape(-1, dim)
                number = kind(q, c)
                if number not in cast:
                    cast = {number: q.astype(number)}
                c = c.astype(number)
                step = max(1, SCORES // len(ids))
                first, last = np.searchsorted(ids, qid), np.searchsorted(ids, qid, "right")  # a block's ids ascend
                for a in range(0, len(of), step):
                    met = np.flatnonzero(last[a : a + step] > first[a : a + step])
                    own = [(m, slice(first[a + m], last[a + m])) for m in met]
                    yield of[a : a + step], ids, cast[number][a : a + step] @ c.T, own

    def strike(s: np.ndarray, own: list) -> np.ndarray:
        for row, cols in own:
            s[row, cols] = LEAST if s.dtype == np.int64 else -np.inf
        return s

    def ranges(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """lo: no more than any score; good: a score that k of this task's candidates reach, if there is one."""
        lo, n = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        top = np.full((size, k), LEAST)  # the best of the largest of stretches: each is another candidate's
        for at, ids, s, own in scored(it, np.arange(size)):
            lo[at] = np.minimum(lo[at], s.min(axis=1).astype(np.int64))
            s = strike(s, own)
            n[at] += len(ids)
            for row, cols in own:
                n[at[row]] -= cols.stop - cols.start
            starts = np.unique(np.linspace(0, len(ids), min(len(ids), 2 * k), endpoint=False).astype(np.int64))
            best = np.maximum.reduceat(s, starts, axis=1)
            own_only = best == -np.inf
            best = np.where(own_only, 0, best).astype(np.int64)
            best[own_only] = LEAST
            top[at] = np.partition(np.concatenate([top[at], best], axis=1), -k, axis=1)[:, -k:]
        of = np.flatnonzero(n)
        yield pd.DataFrame({"q": of, "lo": lo[of], "good": top[of].min(axis=1), "hi": top[of].max(axis=1), "n": n[of]})

    got = here.mapInPandas(ranges, "q long, lo long, good long, hi long, n long").groupBy("q")
    got = got.agg(F.min("lo").alias("lo"), F.max("good").alias("good"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    lo, hi, want = np.zeros(size, np.int64), np.full(size, -1), np.zeros(size, np.int64)
    for r in got:  # want: the kth largest of those in [lo, hi], or the smallest if there are fewer
        lo[r["q"]], hi[r["q"]], want[r["q"]] = max(r["lo"], r["good"]), r["hi"], min(k, r["n"])

    while (hi > lo).any():
        # BINS of them reach from lo beyond hi; differences are unsigned, so that none overflows
        width = (hi.view(np.uint64) - lo.view(np.uint64)) // np.uint64(BINS) + np.uint64(1)
        width = np.where(hi > lo, width, np.uint64(1))
        state = sc.broadcast((lo, hi, width))

        def histograms(it: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            lo, hi, width = state.value
            counts = np.zeros((size, BINS), np.int64)
            some = False
            for of, _, s, own in scored(it, np.flatnonzero(hi > lo)):
                s = strike(s, own)
                at, col = places((s >= level(lo[of], s)) & (s <= level(hi[of], s)))
                bins = (s[at, col].astype(np.int64).view(np.uint64) - lo.view(np.uint64)[of[at]]) // width[of[at]]
                counts[of] += np.bincount(at * BINS + bins.astype(np.int64), minlength=len(of) * BINS).reshape(len(of), BINS)
                some = True
            if some:
                for a in range(0, size, TOGETHER):
                    if counts[a : a + TOGETHER].any():
                        yield pd.DataFrame({"a": [a], "counts": [counts[a : a + TOGETHER].tobytes()]})

        def summed(it: Iterator[pd.DataFrame], state=state, want=want) -> Iterator[pd.DataFrame]:
            """The bin of each query's kth value, and the scores above that bin; rows come sorted by a."""
            before, total = -1, np.zeros(0, np.int64)

            def found() -> pd.DataFrame:
                rows = total.reshape(-1, BINS)
                q = np.arange(before, before + len(rows))
                down = np.cumsum(rows[:, ::-1], axis=1)  # from the highest bin down
                first = (down >= want[q, None]).argmax(axis=1)
                above = np.where(first > 0, down[np.arange(len(q)), first - 1], 0)
                done = rows.any(axis=1)
                return pd.DataFrame({"q": q, "bin": BINS - 1 - first, "above": above})[done]

            for pdf in it:
                for row in pdf.itertuples():
                    if row.a != before:
                        if before >= 0:
                            yield found()
                        before, total = row.a, np.zeros(len(row.counts) // 8, np.int64)
                    total = total + np.frombuffer(row.counts, np.int64)
            if before >= 0:
                yield found()

        counted = here.mapInPandas(histograms, "a long, counts binary").repartition("a").sortWithinPartitions("a")
        lo, hi, want = lo.copy(), hi.copy(), want.copy()
        for r in counted.mapInPandas(summed, "q long, bin long, above long").collect():
            q, w = r["q"], int(width[r["q"]])
            lo[q] += r["bin"] * w
            hi[q] = min(int(hi[q]), int(lo[q]) + w - 1)
            want[q] -= r["above"]

    final = sc.broadcast((lo, hi, want))

    def chosen(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kth, hi, want = final.value
        for of, ids, s, own in scored(it, np.flatnonzero(hi >= kth)):
            s = strike(s, own)
            at, col = places(s >= level(kth[of], s))  # a query's ids ascend: of those that tie the smallest come first
            score = s[at, col].astype(np.int64)
            tie = score == kth[of[at]]
            before = np.cumsum(tie) - tie  # ties before this one, less those before its query
            keep = ~tie | (before - before[np.searchsorted(at, at)] < want[of[at]])
            yield pd.DataFrame({"query_id": queries.value[0][of[at[keep]]], "id": ids[col[keep]], "score": score[keep]})

    return here.mapInPandas(chosen, "query_id long, id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score. candidates, queries: id long, v array<long>, all of them usable."""
    spark = candidates.sparkSession
    ship(spark)
    base = cut(blocks(candidates, BLOCK, "block"))
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    most = queries.agg(F.max(F.size("v")).alias("dim")).collect()[0]["dim"] or 1
    asked = cut(blocks(queries, max(1, QUERY_BYTES // (8 * most)), "part"))
    names = sorted((r["dim"], r["part"]) for r in asked.select("dim", "part").collect())  # one for each block of queries
    out = spark.createDataFrame([], "query_id long, id long, score long")
    for dim in sorted({d for d, _ in names}):
        parts = [p for d, p in names if d == dim]
        for a in range(0, len(parts), ROUND):
            rows = asked.where((F.col("dim") == dim) & F.col("part").isin(parts[a : a + ROUND])).collect()
            out = out.unionByName(_round(base, dim, rows, k))
    best = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))), 1, k).alias("top"))
    out = best.select("query_id", F.posexplode("top").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.down")).alias("score"))


def usable(v: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    whole = lambda x: F.when(F.abs(x) < 2.0**54, F.floor(x.cast("double") * 256)).otherwise(F.raise_error(F.lit("256 times a component doesn't fit 64 bits")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", whole).alias("v"))
    out = top_k(rows, rows.where(F.col("id") % 50 == 0), 5)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


SQL = """
with e as (select vec_id as id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
           from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select id, unnest(v) as c, unnest(range(len(v))) as i, len(v) as dim from e),
s as (select q.id as query_id, c.id as vec_id, cast(sum(q.c * c.c) as bigint) as score
      from x q join x c on q.i = c.i and q.dim = c.dim and q.id <> c.id where q.id % 50 = 0 group by q.id, c.id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
