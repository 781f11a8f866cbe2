"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned (iterative quantisation) on a bounded sample, so that the signs of the rotated, centred
vectors are balanced codes with little quantisation error. Every vector is coded. The code is cut into TABLES
parts, each the key of a table; two vectors meet if in some table their parts differ in at most one bit: a vector
stands in the bucket of its part, and visits those of its part with one of the set bits cleared. What meets is
reranked by the cosine of the original vectors in double precision, and only pairs at or above the threshold link.
A pair is counted in the first table that brings it together, so that each link is counted once.

Equal vectors of a label are one class, which is coded and compared once and counts for as many vectors. Only
buckets with classes that can pair are gathered; a bucket of more than PART classes is dealt out by pairs of parts,
so that none is too large for a task, whatever shares a code. Parts have as many bits as the number of vectors
has, BITS at least, so that buckets don't fill as tables grow.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor
do vectors with a null label or of different lengths; any other finite components are fine, however large or small;
exact copies link like others; rows without an id take no part and come back with null results; repeated ids are
vectors each, and one id's rows get the sum of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, ship, table
from tallyspark.llm.components import components
from tallyspark.llm.topk import usable

THRESHOLD = 0.98
#: Vectors on which the rotation is learned, by a hash of their ids.
SAMPLE = 4000
ROUNDS = 30
TABLES, BITS = 4, 16
#: Vectors of a bucket that one task holds on each side.
PART = 1024
#: Vectors of a bucket that is compared row by row, and vectors of a batch of buckets.
SMALL, ROWS = 16, 4096
#: Cosines this near to the threshold are summed exactly, so that a pair's fate doesn't hang on how it was found.
CLOSE = 1e-9


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """mean, projection (dimensions x bits): principal directions, rotated until signs fit best.

    More bits than dimensions are made of several such groups, each of its own rotation.
    """
    mean = sample.mean(axis=0)
    x = sample - mean
    rng = np.random.default_rng(seed)
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    out = []
    while bits > 0:
        k = min(bits, directions.shape[0])
        pc = directions[:k].T
        v = x @ pc
        r, _ = np.linalg.qr(rng.standard_normal((k, k)))
        for _ in range(rounds):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(pc @ r)
        bits -= k
    return mean, np.concatenate(out, axis=1)


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The tables' keys of unit vectors: rows x tables."""
    signs = ((x - mean) @ projection >= 0).reshape(len(x), tables, width)
    return (signs.astype(np.int64) << np.arange(width)).sum(axis=2)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_least(s: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether cosines s of the rows of a and b reach the threshold."""
    out = s >= threshold
    for k in np.flatnonzero(np.abs(s - threshold) < CLOSE).tolist():
        out[k] = math.fsum((a[k] * b[k]).tolist()) >= threshold
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric matrix of links is connected with."""
    root = np.arange(len(linked))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _links(pdf: pd.DataFrame, threshold: float, everywhere: bool) -> pd.DataFrame:
    """uid, n, to of a bucket (or of two of its parts): links of each class and one that connects what links."""
    v, c = (np.stack([np.frombuffer(x, kind) for x in pdf[f]]) for f, kind in (("v", np.float64), ("code", np.int64)))
    t, bit, part, uid, lab, m = int(pdf["t"].iloc[0]), pdf["bit"].to_numpy(), pdf["p"].to_numpy(), pdf["uid"].to_numpy(), pdf["lab"].to_numpy(), pdf["m"].to_numpy()
    s = v @ v.T
    i, j = np.nonzero(np.triu(s >= threshold - CLOSE, 1))
    ok = _meet(c, bit, lab, i, j, t) & (everywhere | (part[i] != part[j]))
    i, j = i[ok], j[ok]
    hit = at_least(s[i, j], v[i], v[j], threshold)
    linked = np.zeros(s.shape, bool)
    linked[i[hit], j[hit]] = linked[j[hit], i[hit]] = True
    n = linked @ m
    of = np.flatnonzero(n)
    return pd.DataFrame({"uid": uid[of], "n": n[of], "to": uid[_roots(linked)[of]]})


def _meet(c: np.ndarray, bit: np.ndarray, lab: np.ndarray, i: np.ndarray, j: np.ndarray, t) -> np.ndarray:
    """Whether rows i and j, one of which stands in the bucket, meet first in table t."""
    differ = c[i] ^ c[j]
    near = (differ & (differ - 1)) == 0  # by no bit, or by one
    here = differ[np.arange(len(i)), t]
    wanted = np.maximum(bit[i], bit[j]).astype(np.int64)
    same = here == np.where(wanted < 0, 0, np.int64(1) << np.maximum(wanted, 0))
    return (near.argmax(axis=1) == t) & same & (np.minimum(bit[i], bit[j]) < 0) & (lab[i] == lab[j])


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, width: int | None = None, sample: int = SAMPLE
) -> DataFrame:
    """id, n_links, component_id of each usable vector. vectors: id long, label, v array<double>."""
    spark = vectors.sparkSession
    ship(spark)
    sizes = {r["d"]: r["n"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "id long, n_links long, component_id long")
    width = width or max(BITS, sum(sizes.values()).bit_length())
    rotations = {}
    for d in sizes:  # a table has one length as a rule; vectors of any other are coded by their own rotation
        got = vectors.where(F.size("v") == d).select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).collect()
        rotations[d] = learn_rotation(units(np.array([r["v"] for r in got], np.float64)), tables * width)
    shared = spark.sparkContext.broadcast(rotations)  # dimensions x bits

    def code(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for d, part in pdf.groupby(pdf["v"].map(len)):
                x = units(np.array(part["v"].tolist(), np.float64))
                c = codes(x, *shared.value[d], tables, width)
                lab = [xxhash.xxh64_intdigest(f"{d}:{label}") - (1 << 63) for label in part["label"]]
                same = [xxhash.xxh128_digest(r.tobytes()) for r in x]
                yield pd.DataFrame({"uid": part["uid"], "id": part["id"], "lab": lab, "same": same, "v": [r.tobytes() for r in x], "code": [r.tobytes() for r in c], "parts": list(c)})

    numbered = vectors.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", F.col("label").cast("string").alias("label"), "v")
    coded = cut(numbered.mapInPandas(code, "uid long, id long, lab long, same binary, v binary, code binary, parts array<long>"))
    classes = cut(coded.groupBy("lab", "same").agg(F.min("uid").alias("rep"), F.count("*").alias("m")))
    first = coded.join(classes.select(F.col("rep").alias("uid"), "m"), "uid")
    # a class stands in the bucket of each part (bit -1), and visits those of the part without one of its bits
    clear = lambda x, b: x.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    has = lambda x, b: F.call_function("shiftright", x, b).bitwiseAND(F.lit(1).cast("long")) == 1
    every = F.array(*map(F.lit, range(width)))

    def places(t: int):
        x = F.col("parts")[t]
        place = lambda b, key: F.struct(F.lit(t).cast("byte").alias("t"), b.cast("byte").alias("bit"), F.xxhash64("lab", F.lit(t), key).alias("cell"))
        return F.concat(F.array(place(F.lit(-1), x)), F.transform(F.filter(every, lambda b: has(x, b)), lambda b: place(b, clear(x, b))))

    entries = first.select("uid", F.explode(F.concat(*[places(t) for t in range(tables)])).alias("k")).select("uid", "k.*")
    count = entries.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("bit") < 0).alias("stand")).where("n > 1 and stand > 0")
    count = cut(count.select("cell", "n", F.ceil(F.col("n") / PART).cast("long").alias("parts")))
    # a class of part p goes to the cells (p, q) and (q, p) of its bucket
    part = F.pmod(F.xxhash64("uid"), F.col("parts"))
    met = entries.join(count.drop("n"), "cell").withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("uid", "cell", "t", "bit", "p", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of many buckets: small ones all at once, by rows so many places apart; large ones by products of matrices."""
        by = ["cell", "low", "high"]
        pdf = pdf.sort_values([*by, "uid"], ignore_index=True)
        no = pdf.groupby(by, sort=False).ngroup().to_numpy()
        size = np.bincount(no)[no]
        out = [_links(part, threshold, part["low"].iloc[0] == part["high"].iloc[0]) for _, part in pdf[size > SMALL].groupby(no[size > SMALL])]
        pdf, no = pdf[size <= SMALL], no[size <= SMALL]
        if len(pdf):
            v, c = (np.stack([np.frombuffer(x, kind) for x in pdf[f]]) for f, kind in (("v", np.float64), ("code", np.int64)))
            uid, t, bit, part, low, high, lab, m = (pdf[f].to_numpy() for f in ("uid", "t", "bit", "p", "low", "high", "lab", "m"))
            for d in range(1, SMALL):
                i = np.flatnonzero(no[d:] == no[:-d])
                j = i + d
                if not len(i):
                    break
                ok = _meet(c, bit, lab, i, j, t[i]) & ((low[i] == high[i]) | (part[i] != part[j]))
                i, j = i[ok], j[ok]
                hit = at_least(np.einsum("ij,ij->i", v[i], v[j]), v[i], v[j], threshold)
                i, j = i[hit], j[hit]
                out.append(pd.DataFrame({"uid": np.concatenate([uid[i], uid[j]]), "n": np.concatenate([m[j], m[i]]), "to": np.concatenate([uid[j], uid[i]])}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"uid": [], "n": [], "to": []}, dtype="int64")

    rows = count.agg(F.sum(F.col("n") * F.col("parts")).alias("n")).collect()[0]["n"] or 0
    batch = F.pmod(F.xxhash64("cell", "low", "high"), F.lit(1 + rows // ROWS))  # buckets are compared by the batch
    whole = met.join(first.select("uid", "lab", "v", "code", "m"), "uid").withColumn("batch", batch)
    found = cut(whole.groupBy("batch").applyInPandas(compare, "uid long, n long, to long"))
    links = found.groupBy(F.col("uid").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.select("uid", "to"), "uid", "to").select(F.col("node").alias("rep"), "root")
    of_class = classes.join(links, "rep", "left").join(roots, "rep", "left")
    of_class = of_class.select("lab", "same", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    least = coded.select("id", "lab", "same").groupBy("lab", "same").agg(F.min("id").alias("id")).join(of_class.select("lab", "same", "root"), ["lab", "same"])
    of_class = of_class.join(least.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    out = coded.select("id", "lab", "same").join(of_class, ["lab", "same"])
    return out.groupBy("id").agg(F.sum("n_links").cast("long").alias("n_links"), F.min("component_id").alias("component_id"))


def dedup(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row (vec_id, embedding, label)."""
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    found = near_duplicates(good.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")), threshold)
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
      where list_cosine_similarity(a.v, b.v) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as low from r group by a),
n as (select a, count(*) as n from l group by a)
select cast(x.vec_id as bigint) as vec_id, coalesce(n.n, 0) as n_links, cast(least(x.vec_id, coalesce(c.low, x.vec_id)) as bigint) as component_id,
       x.vec_id <= coalesce(c.low, x.vec_id) as kept
from embeddings x left join c on c.a = x.vec_id left join n on n.a = x.vec_id
"""
