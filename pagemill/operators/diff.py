"""Differences between two copies of a keyed dataset, field by field.

``diff_copies`` reports keys only one copy holds and, for shared keys, each scalar field and
each position of a grid field (``ARRAY<ARRAY<STRING>>``) whose values differ.

How duplicates of a key are handled: identical rows of the two copies cancel by multiplicity;
what is left of a key is paired so that the number of differing fields is least (minimum-cost
assignment). With ``latest_by`` only the rows with the newest value of that column count; as one
row a key is meant then, rows left without a partner are repeats and not reported.

Defined results for unusual input:

* null in a key: keys compare null-safe, so ``NULL`` is a key value of its own;
* null in a field: equals only null; a null grid or a null grid row has no positions;
* grids of different shape (null against filled, other numbers of rows or of cells in a row):
  one ``<grid>_shape`` row with both shapes, beside the positions both hold;
* null in ``latest_by``: older than any value; a key with nothing but nulls keeps all its rows;
* ties in ``latest_by``: all tied rows stay, cancel and are paired;
* an empty copy: every key of the other one is ``only_a`` / ``only_b``;
* further columns, whatever their names: ignored; internal columns carry the prefix ``__``.

Scale: two shuffles on (key, content) that combine on the map side. Keys with one leftover row
a side never leave the JVM. Keys with at most ``small_group`` leftovers a side go to an exact
assignment in Arrow batches. Of larger groups, which no task could hold, rows that agree on all
fields but some are paired first by distributed ranks, fewest differing fields first (all sets
of fields up to ``ALL_SETS`` fields, else all but one and then one, so the number of rounds is
linear in the fields); the rest is assigned exactly in blocks of ``small_group`` rows. Every row
is kept; the total there is not proven least (README has the measured gap).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: number of fields up to which large groups try every set of agreeing fields
ALL_SETS = 4
KINDS = ("only_a", "only_b", "extra_a", "extra_b")


def min_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; every index of the shorter axis is used.

    Shortest augmenting paths with potentials, O(n^2 m).
    """
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in min_cost_assignment(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for start in range(n):
        owner[m] = start
        here = m
        dist, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[here] != -1:
            done[here] = True
            r = owner[here]
            open_ = ~done[:m]
            reduced = cost[r] - row_price[r] - col_price[:m]
            better = open_ & (reduced < dist)
            dist[better], via[better] = reduced[better], here
            nxt = int(np.argmin(np.where(open_, dist, np.inf)))
            step = dist[nxt]
            used = np.flatnonzero(done)
            row_price[owner[used]] += step
            col_price[used] -= step
            dist[open_] -= step
            here = nxt
        while here != m:
            owner[here] = owner[via[here]]
            here = via[here]
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] != -1)


def _grid_cost(a, b) -> int:
    if a is None or b is None:
        return int(a is not b)
    bad = abs(len(a) - len(b))
    for x, y in zip(a, b, strict=False):
        if x is None or y is None:
            bad += x is not y
        else:
            bad += abs(len(x) - len(y)) + sum(p != q for p, q in zip(x, y, strict=False))
    return bad


def _pair_small(fields: Sequence[str], grids: Sequence[str]):
    """Exact assignment of the rows of one key, or of one block of it; rows carry their surplus on side a (+) or b (-)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        a = [i for i, n in enumerate(pdf["__n"]) for _ in range(max(n, 0))]
        b = [i for i, n in enumerate(pdf["__n"]) for _ in range(max(-n, 0))]
        cost = np.zeros((len(a), len(b)))
        values = {f: [None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v for v in pdf[f]] for f in fields}
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                cost[i, j] = sum(values[f][p] != values[f][q] for f in fields) + sum(_grid_cost(pdf[g][p], pdf[g][q]) for g in grids)
        pairs = min_cost_assignment(cost)
        out = [(a[i], b[j]) for i, j in pairs]
        used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
        out += [(a[i], None) for i in range(len(a)) if i not in used_a] + [(None, b[j]) for j in range(len(b)) if j not in used_b]
        ids = pdf["__row"].tolist()
        return pd.DataFrame({"__a": [None if p is None else ids[p] for p, _ in out], "__b": [None if q is None else ids[q] for _, q in out]}, dtype=object)

    return run


def _ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """``__k``: 1, 2, ... within ``by`` without one task per group: local ranks in hash
    slices plus the running size of the earlier slices."""
    df = df.withColumn("__slice", F.pmod(F.col("__row"), F.lit(64)))
    local = df.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__slice").orderBy("__row")).cast("long"))
    sizes = df.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__size"))
    w = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(w), F.lit(0))).drop("__size")
    s = sizes.select([F.col(c).alias(f"__s_{c}") for c in sizes.columns])
    cond = F.lit(True)
    for c in [*by, "__slice"]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return local.join(s, cond).withColumn("__k", F.col("__k") + F.col("__s___before")).drop(*s.columns, "__slice")


def _agreeing(fields: list[str]) -> list[tuple[str, ...]]:
    """Sets of fields that paired rows of a large group agree on, largest sets first."""
    if len(fields) <= ALL_SETS:
        return [c for k in range(len(fields) - 1, 0, -1) for c in combinations(fields, k)]
    return [*combinations(fields, len(fields) - 1), *combinations(fields, 1)]


def _pair_large(rows: DataFrame, keys: list[str], hashes: list[str], assign, block: int) -> DataFrame:
    """Pairs of row ids for groups too large for one task. ``rows``: __row, keys, content,
    __n (surplus) and one hash column a field; ``assign`` pairs the rows of one block."""
    from pagemill.session import cut

    unit = rows.withColumn("__u", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n")))).withColumn("__id", F.struct("__row", "__u"))
    bare = unit.select("__id", "__row", "__n", *keys, *hashes)
    pairs = rows.sparkSession.createDataFrame([], _PAIR)
    for kept in _agreeing(hashes):
        by = [*keys, *kept]
        a = _ranked(bare.filter("__n > 0"), by).select(*by, "__k", F.col("__id").alias("__ia"))
        b = _ranked(bare.filter("__n < 0"), by).select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col("__k").alias("__rk"), F.col("__id").alias("__ib"))
        cond = F.col("__k") == F.col("__rk")
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        met = cut(a.join(b, cond).select("__ia", "__ib"))
        pairs = pairs.unionAll(met.select("__ia.__row", "__ib.__row").toDF("__a", "__b"))
        gone = met.select(F.col("__ia").alias("__id")).unionAll(met.select(F.col("__ib").alias("__id")))
        bare = bare.join(gone, "__id", "left_anti")
    side = _ranked(bare.withColumn("__side", F.signum("__n")), [*keys, "__side"]).select("__id", F.floor((F.col("__k") - 1) / block).alias("__block"))
    rest = unit.join(side, "__id").withColumn("__n", F.signum("__n").cast("long")).drop("__id", "__u", *hashes)
    return pairs.unionAll(rest.groupBy(*keys, "__block").applyInPandas(assign, _PAIR))


_PAIR = "__a long, __b long"


def _hashes(fields: Sequence[str], grids: Sequence[str]) -> dict[str, Column]:
    """Hashes that nulls change (xxhash64 passes over them, inside arrays as well): one a field
    and two a grid, of its even and its odd columns, so that grids apart in one cell agree in one."""
    out = [F.when(F.col(f).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(f), F.lit(1))) for f in fields]
    for g in grids:
        for odd in (0, 1):
            half = F.transform(F.col(g), lambda r, odd=odd: F.filter(r, lambda _, i: i % 2 == odd))
            out.append(F.when(F.col(g).isNull(), F.lit(0)).otherwise(F.xxhash64(F.to_json(half), F.lit(1))))
    return {f"__f{i}": c for i, c in enumerate(out)}


def leftovers(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], grids: Sequence[str] = (), latest_by: str | None = None) -> DataFrame:
    """Rows of (keys, content) with ``__n``: copies that ``a`` holds more (+) or ``b`` (-), and
    ``__ka``/``__kb``: whether the key is in each copy at all. Identical rows have cancelled."""
    cols = [*keys, *fields, *grids]
    sides = []
    for df, tag in ((a, 1), (b, -1)):
        side = df.select(*cols, *([F.col(latest_by).alias("__at")] if latest_by else []))
        if latest_by:
            newest = side.groupBy(*keys).agg(F.max("__at").alias("__newest"))
            newest = newest.select(*[F.col(k).alias(f"__n_{k}") for k in keys], "__newest")
            cond = F.col("__at").eqNullSafe(F.col("__newest"))
            for k in keys:
                cond = cond & F.col(k).eqNullSafe(F.col(f"__n_{k}"))
            side = side.join(newest, cond).select(*cols)
        sides.append(side.withColumn("__side", F.lit(tag).cast("long")))
    content = sides[0].unionAll(sides[1]).groupBy(*cols).agg(F.sum("__side").alias("__n"), F.max("__side").alias("__hi"), F.min("__side").alias("__lo"))
    held = content.groupBy(*keys).agg((F.max("__hi") == 1).alias("__ka"), (F.min("__lo") == -1).alias("__kb"), F.sum(F.greatest("__n", F.lit(0))).alias("__na"), F.sum(F.greatest(-F.col("__n"), F.lit(0))).alias("__nb"))
    held = held.select(*[F.col(k).alias(f"__h_{k}") for k in keys], "__ka", "__kb", "__na", "__nb")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__h_{k}"))
    return content.filter("__n <> 0").join(held, cond).drop(*[f"__h_{k}" for k in keys], "__hi", "__lo")


def pair_copies(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], grids: Sequence[str] = (), latest_by: str | None = None, small_group: int = 200) -> DataFrame:
    """One row a difference pair: keys, ``__a``/``__b`` structs of the content (null = none),
    ``__ka``/``__kb``. Rows equal in both copies do not appear."""
    from pagemill.session import cut

    keys, fields, grids = list(keys), list(fields), list(grids)
    content = [*fields, *grids]
    left = cut(leftovers(a, b, keys, fields, grids, latest_by))
    whole = F.struct(*content)
    single = left.filter("__na <= 1 AND __nb <= 1").groupBy(*keys, "__ka", "__kb").agg(
        F.first(F.when(F.col("__n") > 0, whole), ignorenulls=True).alias("__a"),
        F.first(F.when(F.col("__n") < 0, whole), ignorenulls=True).alias("__b"),
    )
    many = left.filter("__na > 1 OR __nb > 1")
    if many.isEmpty():
        return single
    many = cut(many.withColumn("__row", F.monotonically_increasing_id()))  # written, so ids stay
    bare = many.drop("__ka", "__kb")
    lone = many.filter("__na = 0 OR __nb = 0")
    both = bare.filter("__na > 0 AND __nb > 0")
    assign = _pair_small(fields, grids)
    small = both.filter((F.col("__na") <= small_group) & (F.col("__nb") <= small_group))
    pairs = small.groupBy(*keys).applyInPandas(assign, _PAIR)
    large = both.filter((F.col("__na") > small_group) | (F.col("__nb") > small_group))
    if not large.isEmpty():
        hashes = _hashes(fields, grids)
        pairs = pairs.unionAll(_pair_large(large.withColumns(hashes), keys, list(hashes), assign, small_group))
    unit = lone.withColumn("__u", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n"))))
    pairs = pairs.unionAll(unit.select(F.when(F.col("__n") > 0, F.col("__row")).alias("__a"), F.when(F.col("__n") < 0, F.col("__row")).alias("__b")))
    value = many.select("__row", F.struct(*keys).alias("__keys"), F.struct("__ka", "__kb").alias("__in"), whole.alias("__v"))
    got = (
        pairs.select(F.col("__a").alias("__ra"), F.col("__b").alias("__rb"))
        .join(value.select(F.col("__row").alias("__ra"), F.col("__keys").alias("__k1"), F.col("__in").alias("__i1"), F.col("__v").alias("__a")), "__ra", "left")
        .join(value.select(F.col("__row").alias("__rb"), F.col("__keys").alias("__k2"), F.col("__in").alias("__i2"), F.col("__v").alias("__b")), "__rb", "left")
    )
    got = got.withColumn("__k", F.coalesce("__k1", "__k2")).withColumn("__i", F.coalesce("__i1", "__i2"))
    return single.unionByName(got.select("__k.*", F.col("__i.__ka").alias("__ka"), F.col("__i.__kb").alias("__kb"), "__a", "__b"))


def _positions(a: Column, b: Column) -> Column:
    """(row, col) of each position that both grids hold and whose values differ."""
    rows = F.arrays_zip(a.alias("x"), b.alias("y"))
    both = F.least(F.size(a), F.size(b))
    per_row = F.transform(
        F.slice(rows, 1, F.greatest(both, F.lit(0))),
        lambda r, i: F.transform(
            F.filter(
                F.when(
                    r["x"].isNotNull() & r["y"].isNotNull() & (F.least(F.size(r["x"]), F.size(r["y"])) > 0),
                    F.transform(
                        F.sequence(F.lit(0), F.least(F.size(r["x"]), F.size(r["y"])) - 1),
                        lambda j: F.struct(j.alias("j"), (~F.get(r["x"], j).eqNullSafe(F.get(r["y"], j))).alias("d")),
                    ),
                ).otherwise(F.array().cast("array<struct<j:int,d:boolean>>")),
                lambda s: s["d"],
            ),
            lambda s: F.struct(i.alias("cell_row"), s["j"].alias("cell_col")),
        ),
    )
    return F.when(a.isNotNull() & b.isNotNull() & (both > 0), F.flatten(per_row))


def _shape(g: Column) -> Column:
    """Cells in each row as text (null row: -), null for a null grid."""
    return F.concat_ws(",", F.transform(g, lambda r: F.when(r.isNull(), F.lit("-")).otherwise(F.size(r).cast("string")))).substr(F.lit(1), F.when(g.isNull(), None).otherwise(F.lit(1 << 30)))


def diff_copies(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], grid: str | None = None, latest_by: str | None = None, small_group: int = 200, values: bool = False) -> DataFrame:
    """Report the differences of two copies.

    Columns: keys, ``diff_kind``, ``cell_row``, ``cell_col`` (-1 unless the kind is ``cell``)
    and, with ``values``, both values as strings. Kinds: ``only_a``/``only_b`` (the key is in
    one copy only, one row a key), ``extra_a``/``extra_b`` (a shared key of which one copy
    holds more rows, one row each; not with ``latest_by``), the name of a scalar field that
    differs, ``<grid>_shape`` and ``cell``.
    """
    grids = [grid] if grid else []
    p = pair_copies(a, b, keys, fields, grids, latest_by, small_group)
    none = F.lit(None).cast("string")

    def item(kind: Column, row: Column, col: Column, va: Column = none, vb: Column = none) -> Column:
        return F.struct(kind.alias("diff_kind"), row.cast("int").alias("cell_row"), col.cast("int").alias("cell_col"), va.alias("value_a"), vb.alias("value_b"))

    no = F.lit(-1)
    made = [
        F.when(F.col("__b").isNull(), F.array(item(F.when(F.col("__kb"), "extra_a").otherwise("only_a"), no, no))),
        F.when(F.col("__a").isNull(), F.array(item(F.when(F.col("__ka"), "extra_b").otherwise("only_b"), no, no))),
    ]
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for f in fields:
        x, y = F.col(f"__a.{f}"), F.col(f"__b.{f}")
        made.append(F.when(both & ~x.eqNullSafe(y), F.array(item(F.lit(f), no, no, x.cast("string"), y.cast("string")))))
    if grid:
        x, y = F.col(f"__a.{grid}"), F.col(f"__b.{grid}")
        at = lambda g, s: F.get(F.get(g, s["cell_row"]), s["cell_col"])
        made.append(F.when(both & ~_shape(x).eqNullSafe(_shape(y)), F.array(item(F.lit(f"{grid}_shape"), no, no, _shape(x), _shape(y)))))
        made.append(F.when(both, F.transform(_positions(x, y), lambda s: item(F.lit("cell"), s["cell_row"], s["cell_col"], at(x, s), at(y, s)))))
    empty = F.array().cast("array<struct<diff_kind:string,cell_row:int,cell_col:int,value_a:string,value_b:string>>")
    out = p.select(*keys, F.explode(F.concat(*[F.coalesce(m, empty) for m in made])).alias("__d"))
    out = out.select(*keys, "__d.diff_kind", "__d.cell_row", "__d.cell_col", *(["__d.value_a", "__d.value_b"] if values else []))
    if latest_by:  # repeats of the newest row on both sides say the same again
        return out.filter(~F.col("diff_kind").isin("extra_a", "extra_b")).distinct()
    lone = out.diff_kind.isin("only_a", "only_b")
    return out.filter(~lone).unionAll(out.filter(lone).dropDuplicates([*keys, "diff_kind"]))
