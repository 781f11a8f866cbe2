"""Splits, training-only resampling and class weights, ordered by a hash of the id, so that they are reproducible."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyspark.functions.scalar import ID, TARGET, client, order_hash
from tallyspark.operators.ordering import number

#: Places of a block, in which neighbours are sought; most slices in which places are put in order; features whose sums are written out.
BLOCK, SLICES, FEW = 64, 64, 8


def _share(n: float) -> bool:
    return 0 < n <= 1


def split_622(df: DataFrame, seed: int, check: bool = True) -> DataFrame:
    """df with `split`: of each client 20 % test and a quarter of the rest validation, by label in proportion.

    Sizes are those of rounding up each client's share; within it labels get largest remainders, so that sizes are
    exact. Raises ValueError for an empty table, repeated ids, or a client whose rows are too few to cut: a part with
    fewer rows than there are labels, or a label with a single row before a cut.
    """
    g = df.select(ID, TARGET).groupBy(client().alias("client"), TARGET).count()
    by = Window.partitionBy("client")

    def quota(n: str, share: float, name: str, d: DataFrame) -> DataFrame:
        total = F.ceil(F.sum(n).over(by) * share - 1e-9)
        exact = F.col(n) * total / F.sum(n).over(by)
        d = d.withColumns({"_floor": F.floor(exact), "_part": exact - F.floor(exact), "_total": total})
        rank = F.row_number().over(by.orderBy(F.desc("_part"), F.col(TARGET)))
        spare = F.col("_total") - F.sum("_floor").over(by)
        return d.withColumn(name, F.col("_floor") + (rank <= spare).cast("long")).drop("_floor", "_part", "_total")

    g = quota("count", 0.2, "n_test", g)
    g = quota("rest", 0.25, "n_validation", g.withColumn("rest", F.col("count") - F.col("n_test")))
    if check:
        sums = g.groupBy("client").agg(*[F.sum(c).alias(c) for c in ("count", "rest", "n_test", "n_validation")], F.min("count").alias("rare"), F.min(F.when(F.col("rest") > 0, F.col("rest"))).alias("rarer"), F.count("*").alias("labels"))
        rows = sums.collect()  # one row for each client
        if not rows:
            raise ValueError("nothing to split: no consumer has a label")
        small = sorted(
            r["client"] for r in rows
            if min(r["n_test"], r["n_validation"], r["rest"] - r["n_validation"]) < r["labels"] or (r["labels"] > 1 and min(r["rare"], r["rarer"]) < 2)
        )
        if small:
            raise ValueError(f"too few rows for a split by label: clients {small}")
        if df.groupBy(ID).count().where("count > 1").limit(1).count():
            raise ValueError("a consumer would be in several parts: ids repeat")
    g = g.select("client", F.col(TARGET).alias("_y"), "n_test", "n_validation")
    ranked = number(df.withColumn("_client", client()), ["_client", TARGET], order_hash(seed, ID), ID, "_rank")
    out = ranked.join(F.broadcast(g), F.col("_client").eqNullSafe(F.col("client")) & F.col(TARGET).eqNullSafe(F.col("_y")))  # two rows for each client
    kind = F.when(F.col("_rank") <= F.col("n_test"), "test").when(F.col("_rank") <= F.col("n_test") + F.col("n_validation"), "validation").otherwise("train")
    return out.select(*df.columns, kind.alias("split"))


def split_manifest(split: DataFrame) -> DataFrame:
    return split.select(ID, client().alias("client"), "split")


def downsample_negatives(df: DataFrame, keep_ratio: float, seed: int) -> DataFrame:
    """All positives and round(n * keep_ratio) of the n negatives."""
    if not _share(keep_ratio):
        raise ValueError(f"a share of {keep_ratio} of the negatives can't be kept")
    negative = ~F.coalesce(F.col(TARGET) == 1, F.lit(False))
    some = df.where(negative)
    n = some.agg(F.lit(0).alias("_all"), F.bround(F.count("*") * F.lit(keep_ratio), 0).alias("_keep"))  # one row
    ranked = number(some, [], order_hash(seed, ID), ID, "_rank").withColumn("_all", F.lit(0))
    kept = ranked.join(F.broadcast(n), "_all").where(F.col("_rank") <= F.col("_keep"))
    return df.where(~negative).unionByName(kept.select(*df.columns))


def survey(points: DataFrame, keys: list[str], block: int = BLOCK) -> tuple[DataFrame, int]:
    """A row for each of keys, gathered at once, and the number of features. A row: n, dims, the feature p that varies most, and cuts of its values into slices of about 32 blocks.

    Cuts are approximate quantiles, so that another run may give others; what is dealt out by them has to see the same.
    """
    at = ", ".join(f"{i / SLICES}D" for i in range(1, SLICES))
    each = points.selectExpr(*keys, "posexplode(x) as (p, v)").groupBy(*keys, "p").agg(F.expr("var_pop(v) as w"), F.expr("count(*) as n"), F.expr(f"percentile_approx(v, array({at}), 1000) as cuts"))
    most = each.groupBy(*keys).agg(F.expr("max(n) as n"), F.expr("int(count(*)) as dims"), F.expr("max_by(struct(p, cuts), struct(w, -p)) as m")).select(*keys, "n", "dims", "m.p", "m.cuts")
    rows = most.collect()  # one row for each of keys
    thinned = []
    for r in rows:
        slices = min(SLICES, max(1, r["n"] // (32 * block)))
        thinned.append((*r[:-1], sorted({r["cuts"][round(i * SLICES / slices) - 1] for i in range(1, slices)})))
    schema = most.schema
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in thinned], to_arrow_schema(schema))
    return points.sparkSession.createDataFrame(table, schema), max((r["dims"] for r in rows), default=0)


def first_rows(df: DataFrame, window: str, n: int, value: str, name: str) -> DataFrame:
    """The first row of each partition of the window, with `name`: value of the first n. One exchange does, while a group by floats would need another."""
    first = df.selectExpr("*", f"row_number() over ({window}) as _r").where(f"_r <= {n}")
    return first.selectExpr("*", f"collect_list({value}) over ({window} rows between unbounded preceding and unbounded following) as {name}").where("_r = 1").drop("_r")


def nearest(points: DataFrame, keys: list[str], k: int, block: int = BLOCK, surveyed: tuple[DataFrame, int] | None = None) -> DataFrame:
    """keys, x, id, near: the points of the same keys nearest to each place x (by squared distance, then id). points: keys, id, x array.

    If one point only is at x, near has k others; else k + 1, those at x included, so that each finds k beside itself. id
    is the smallest at x. Points at one place share their neighbours, so of each place the k + 1 smallest ids are kept. Places are cut into
    slices and blocks along the feature that varies most. The places beside it in that order tell a distance within
    which k + 1 points lie; then a place meets those blocks only whose box reaches within that distance, which leaves
    none of its neighbours out.
    """
    cuts, dims = surveyed or survey(points, keys, block)

    # sums are written out for a few features, as that is compiled
    def distance(x: str, y: str) -> str:
        if dims > FEW:
            return f"aggregate(zip_with({x}, {y}, (_p, _q) -> (_p - _q) * (_p - _q)), 0.0D, (_s, _t) -> _s + _t)"
        return " + ".join(["0.0D", *(f"(get({x}, {f}) - get({y}, {f})) * (get({x}, {f}) - get({y}, {f}))" for f in range(dims))])

    def apart(lo: str, hi: str, lo2: str, hi2: str) -> str:
        """No more than any distance, as rounded, from what lies between lo and hi to what lies between the others. Not known: 0."""
        gap = lambda a, b: f"nanvl(greatest({a}, {b}, 0.0D), 0.0D)"
        if dims > FEW:
            less = lambda a, b: f"zip_with({a}, {b}, (_p, _q) -> _p - _q)"
            return f"aggregate(zip_with({less(lo, hi2)}, {less(lo2, hi)}, (_g, _h) -> {gap('_g', '_h')}), 0.0D, (_s, _t) -> _s + _t * _t)"
        gaps = [gap(f"get({lo}, {f}) - get({hi2}, {f})", f"get({lo2}, {f}) - get({hi}, {f})") for f in range(dims)]
        return " + ".join(["0.0D", *(f"{g} * {g}" for g in gaps)])

    def ends(lo: str, hi: str) -> list[Column]:
        return [F.expr(f"array({', '.join(f'{way}(get({c}, {f}))' for f in range(dims))})") for way, c in (("min", lo), ("max", hi))]

    by = ", ".join(keys)
    alike, inside = f"partition by {by}, x order by id", f"partition by {by}, _slice order by _v, x"
    places = first_rows(points.select(*keys, "x", "id"), alike, k + 1, "id", "ids").join(F.broadcast(cuts), keys).selectExpr(*keys, "x", "ids", "get(x, p) as _v", "cuts")
    places = places.selectExpr(*keys, "x", "ids", "_v", "size(filter(cuts, c -> c < _v)) as _slice")
    blocked = places.selectExpr("*", f"floor((row_number() over ({inside}) - 1) / {block}) as _b")

    lo, hi = ends("x", "x")
    # that ids are counted keeps them here, so that this and what follows read the same exchange
    boxes = blocked.groupBy(*keys, "_slice", "_b").agg(lo.alias("lo"), hi.alias("hi"), F.expr("sum(size(ids)) as held")).where("held > 0")
    lo_all, hi_all = ends("lo", "hi")
    boxes = boxes.groupBy(*keys, F.col("_slice").alias("_s")).agg(lo_all.alias("lo_all"), hi_all.alias("hi_all"), F.expr("collect_list(struct(_b, lo, hi)) as boxes"))  # a row for each slice

    reach = min(block, k * max(dims, 1))  # the more features, the less does the order along one tell
    asking = blocked.selectExpr("*", f"collect_list(x) over ({inside} rows between {reach} preceding and {reach} following) as _beside")
    bound = f"get(sort_array(transform(_beside, _y -> {distance('x', '_y')})), {k})"
    # no bound: NaN, which is above all distances
    asking = asking.selectExpr(*keys, "_slice", "_b", "x", "ids", f"if(size(ids) > {k}, 0.0D, coalesce({bound}, double('NaN'))) as r")
    asking = asking.groupBy(*keys, "_slice", "_b").agg(lo.alias("lo"), hi.alias("hi"), F.expr("max(r) as r"), F.expr("collect_list(struct(x, r, get(ids, 0) as id, size(ids) = 1 as alone)) as asked"))
    visits = asking.drop("_slice", "_b").join(F.broadcast(boxes), keys).where(f"{apart('lo', 'hi', 'lo_all', 'hi_all')} <= r")
    visits = visits.selectExpr(*keys, "_s as _slice", "asked", f"explode(filter(boxes, _o -> {apart('lo', 'hi', '_o.lo', '_o.hi')} <= r)) as to")
    visits = visits.selectExpr(*keys, "_slice", "to._b as _b", f"explode(filter(asked, _a -> {apart('_a.x', '_a.x', 'to.lo', 'to.hi')} <= _a.r)) as a")

    there = blocked.selectExpr(*keys, "_slice", "_b", "x as y", "ids")
    met = visits.selectExpr(*keys, "_slice", "_b", "a.*").join(there, [*keys, "_slice", "_b"]).selectExpr(*keys, "x", "r", "id", "alone", "ids", "y", f"{distance('x', 'y')} as d")
    met = met.where("d <= r").drop("r")
    near = first_rows(met, f"partition by {by}, x order by d, ids", k + 1, "struct(d, ids, y)", "near")
    near = near.selectExpr(*keys, "x", "id", "alone", f"slice(sort_array(flatten(transform(near, o -> transform(o.ids, i -> struct(o.d as d, i as id, o.y as x))))), 1, {k + 1}) as near")
    return near.selectExpr(*keys, "x", "id", f"if(alone, slice(filter(near, o -> o.id != id), 1, {k}), near) as near")


def augment_clients(df: DataFrame, features: list[str], multiplier: float, neighbors: int, seed: int, keys: Column | None = None) -> DataFrame:
    """df, zero-filled, with synthetic positives on the segments between positives and their nearest neighbours.

    Neighbours are sought among the positives of the same key (the client, unless told otherwise), once for each place
    that positives have. A key with a single positive, or with a multiplier that adds none, stays as it is.
    """
    if neighbors < 1 or not (math.isfinite(multiplier) and multiplier >= 1):
        raise ValueError(f"no augmentation by {multiplier} with {neighbors} neighbours")
    key = client() if keys is None else keys
    filled = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    positives = filled.where(F.col(TARGET) == 1).select(key.alias("key"), F.col(ID).alias("id"), F.array(*features).alias("x"))
    points = number(positives.withColumn("_id", F.col("id")), ["key"], order_hash(seed, "id"), "_id", "i", few=True).withColumn("i", F.col("i") - 1).drop("_id")
    unit = lambda salt: f"double(conv(substring(md5(concat_ws('|', string(j), '{salt}', '{seed}')), 1, 12), 16, 10)) / {1 << 48}D"
    surveyed = survey(positives, ["key"])
    sizes = surveyed[0].selectExpr("key", "n", f"bigint(bround(n * {float(multiplier)!r}D, 0)) - n as extra", f"least({neighbors}L, n - 1) as k")
    draws = sizes.where("n > 1 and extra > 0").selectExpr("key", "n", "k", "explode(sequence(0L, extra - 1)) as j")
    draws = draws.selectExpr("key", "j", f"floor({unit('base')} * n) as i", f"int(floor({unit('pick')} * k) + 1) as pick", f"{unit('alpha')} as alpha")
    near = nearest(positives, ["key"], neighbors, surveyed=surveyed).drop("id")
    made = draws.join(points, ["key", "i"]).join(near, ["key", "x"])
    # a base point is no neighbour of its own
    made = made.selectExpr("id", "j", "x", "alpha", "element_at(filter(near, o -> o.id != id), pick).x as to")
    between = [F.expr(f"x[{i}] + alpha * (to[{i}] - x[{i}])").alias(f) for i, f in enumerate(features)]
    made = made.select(F.expr("concat(id, '#s', string(j))").alias(ID), *between, F.lit(1).cast(df.schema[TARGET].dataType).alias(TARGET))
    return filled.unionByName(made, allowMissingColumns=True)


def augment_positives(df: DataFrame, features: list[str], multiplier: float, neighbors: int, seed: int) -> DataFrame:
    """augment_clients with all rows as one group."""
    return augment_clients(df, features, multiplier, neighbors, seed, F.lit(0))


def resample_group(df: DataFrame, features: list[str], name: str, training: dict, seed: int) -> DataFrame:
    """Downsampling, then augmentation, where the training section lists the client."""
    if name in training.get("downsample_negative_clients", ()):
        df = downsample_negatives(df, training.get("downsample_negative_keep_ratio", 0.2), seed)
    if name in training.get("smote_positive_clients", ()):
        df = augment_positives(df, features, training.get("smote_positive_multiplier", 2.0), training.get("smote_k_neighbors", 5), seed)
    return df


def sample_weights(training: dict, label: str = TARGET) -> Column | None:
    """Inverse keep ratio for negatives, inverse multiplier for positives; None if weights are off."""
    if not training.get("sample_weight", False):
        return None
    keep, times = training.get("downsample_negative_keep_ratio", 1.0), training.get("smote_positive_multiplier", 1.0)
    if not _share(keep) or not math.isfinite(times) or times < 1:
        raise ValueError(f"no weights undo a share of {keep} and a multiple of {times}")
    return F.when(F.col(label) == 0, 1.0 / keep).otherwise(1.0 / times)
