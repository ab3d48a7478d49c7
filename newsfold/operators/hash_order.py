"""Exact, repeatable selection of the first rows by a hash order.

Samples and splits need "the k smallest rows of each group", where a group may
hold half of the table. Sorting a group in one task does not scale, so the rank
is turned into a threshold by radix selection: a row's code is the md5 of its key
and, behind it, the md5 of the whole row. Rows are counted by the first digits of
their codes; then, inside the digits in which the k-th row falls, by the next
ones, until a limit parts the rows exactly. A step is one aggregate with at most
65,536 counters for each limit. Afterwards every row is placed by comparing its
own code, without a shuffle of the rows.
"""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold.session import reliable_checkpoint, unused_name

# Digits of a step: 16**4 counters for each limit. Digits of the key's hash, and of the whole code.
STEP, KEY, CODE = 4, 32, 64
# Groups are labels, languages and runs; one threshold row each goes through the driver.
MAX_GROUPS = 100_000

# Limits above and below every code.
EVERY_ROW, NO_ROW = "g", "!"

Quotas = Mapping[tuple, Sequence[int]]


def hash_order(seed: int, *keys: str) -> Column:
    """md5 of the seed and the keys: the order of all samples and splits."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def row_digest(df: DataFrame) -> Column:
    """md5 of the whole row: equal only for full copies."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def mark_smallest(
    df: DataFrame,
    groups: Sequence[str],
    quotas: Quotas | Callable[[Mapping[tuple, int]], Quotas],
    order: Column,
    out: str,
    lookup: DataFrame | None = None,
    on: Sequence[str] = (),
) -> DataFrame:
    """Add ``out``: 0 for the first quota of a group's rows by ``order``, 1 for the next quota, and so on.

    ``quotas`` maps each group (tuple of the ``groups`` columns) to its quotas, or
    makes that map from the group sizes, which cost no pass of their own; rows after the last quota get ``len(quotas)``, groups not named get null.
    Without ``groups`` the whole frame is one group, named ``()``.
    Sizes are exact. Rows of equal ``order`` are told apart by their other
    columns; full copies of one row may fall on both sides of a limit.

    With ``lookup`` (a small table) the rows are first joined to it by ``on``,
    and may repeat, once per group. Counting then runs before the rows multiply.
    """
    groups, on = list(groups), list(on)
    fields, quotas, limits = find_limits(df, groups, quotas, order, lookup, on)
    rows = df if lookup is None else df.join(F.broadcast(lookup), on)
    whole = F.concat(order, row_digest(df))
    limit_type = T.StructType([T.StructField("upto", T.StringType()), T.StructField("copies", T.LongType())])
    needs_row = any(len(upto) > KEY for upto, _ in limits.values())
    placed = rows.withColumn("_code", whole if needs_row else order)
    if groups:
        table = df.sparkSession.createDataFrame(
            [(*g, [limits[g, cut] for cut in range(len(sizes))]) for g, sizes in quotas.items()],
            T.StructType([*fields, T.StructField("_limits", T.ArrayType(limit_type))]),
        )
        match = [placed[c].eqNullSafe(table[c]) for c in groups]
        placed = placed.join(F.broadcast(table), match, "left").select(*[placed[c] for c in placed.columns], "_limits")
    else:
        cells = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(x, limit_type)]) for x in limits.values()]
        placed = placed.withColumn("_limits", F.array(*cells))
    width = max((len(sizes) for sizes in quotas.values()), default=0)
    if all(copies is None for _, copies in limits.values()):
        return placed.withColumn(out, _part(width)).drop("_code", "_limits")

    # A limit falls among full copies of one row, so these copies need numbers.
    # They stay in their partitions; only counts per partition are summed up.
    on_copies = F.exists("_limits", lambda x: x["copies"].isNotNull() & (x["upto"] == F.col("_code")))
    is_copy = F.coalesce(on_copies, F.lit(False))
    numbered = copy_numbers(placed.filter(is_copy), [*groups, "_code"], "_copy")
    marked = numbered.withColumn(out, _part(width, F.col("_copy"))).drop("_copy")
    rest = placed.filter(~is_copy).withColumn(out, _part(width))
    return rest.unionByName(marked).drop("_code", "_limits")


def find_limits(
    df: DataFrame,
    groups: Sequence[str],
    quotas: Quotas | Callable[[Mapping[tuple, int]], Quotas],
    order: Column,
    lookup: DataFrame | None = None,
    on: Sequence[str] = (),
) -> tuple[list[T.StructField], Quotas, dict]:
    """Fields of the groups, their quotas, and for each (group, number of the quota) the last code inside.

    A code is told by its first digits; if full copies of the row stand there, also by how many of these are inside.
    """
    groups, on = list(groups), list(on)
    whole = F.concat(order, row_digest(df))
    types = {f.name: f.dataType for f in [*df.schema.fields, *(lookup.schema.fields if lookup is not None else [])]}
    fields = [T.StructField(c, types[c]) for c in groups]

    def digits(n: int) -> Column:
        return F.substring(order if n <= KEY else whole, 1, n)

    def counted(known: int, parents: list[str], n: int) -> DataFrame:
        """Rows by their first ``n`` digits, of those whose first ``known`` are among the parents."""
        source = df if not known else df.filter(digits(known).isin(parents))
        base = [c for c in df.columns if c in groups or c in on]
        level = source.groupBy(*base, digits(known).alias("parent"), digits(n).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        if lookup is not None:
            level = level.join(F.broadcast(lookup), on)
            level = level.groupBy(*groups, "parent", "value").agg(F.sum("n").alias("n"))
        return level

    first = counted(0, [], STEP)
    if callable(quotas):
        first = first.persist()
    try:
        if callable(quotas):
            quotas = quotas(_group_sizes(first, groups))
        if len(quotas) > MAX_GROUPS:
            raise ValueError(f"{len(quotas)} groups; at most {MAX_GROUPS} are supported")
        limits = _limits(df, quotas, fields, order, first, counted)
    finally:
        first.unpersist()
    return fields, quotas, limits


def _limits(df: DataFrame, quotas: Quotas, fields: list, order: Column, first: DataFrame, counted: Callable) -> dict:
    """For each (group, cut): the last code inside, by its first digits, and how many copies of the row count if it is one."""
    limits = {(group, cut): (NO_ROW, None) for group, sizes in quotas.items() for cut in range(len(sizes))}
    # What a cut is still looking for: the digits it falls in so far, the rows wanted of these, and how many there are.
    wanted = {}
    for group, sizes in quotas.items():
        for cut in range(len(sizes)):
            if sum(sizes[: cut + 1]) > 0:
                wanted[group, cut] = ("", sum(sizes[: cut + 1]), None)
    while wanted:
        known = min(len(parent) for parent, _, _ in wanted.values())
        now = {key: x for key, x in wanted.items() if len(x[0]) == known}
        n = min(known + STEP, KEY if known < KEY else CODE)
        level = counted(known, sorted({parent for parent, _, _ in now.values()}), n) if known else first
        hits = _locate(level, fields, {key: x[:2] for key, x in now.items()})
        one_key: dict[str, str | None] = {}
        for key, (_, _, before) in now.items():
            del wanted[key]
            if key not in hits:  # the quota is above the size of the group
                limits[key] = (EVERY_ROW, None)
                continue
            found, want, size = hits[key]
            if want == size:
                limits[key] = (found, None)
            elif len(found) == CODE:
                limits[key] = (found, want)
            else:
                # Digits that part nothing may be those of a single key with many rows: go on behind it at once.
                if size == before and len(found) < KEY:
                    if found not in one_key:
                        ends = df.filter(F.substring(order, 1, len(found)) == found).agg(F.min(order), F.max(order)).first()
                        one_key[found] = ends[0] if ends[0] == ends[1] else None
                    found = one_key[found] or found
                wanted[key] = (found, want, size)
    return limits


def _group_sizes(level: DataFrame, groups: list[str]) -> dict[tuple, int]:
    rows = level.groupBy(*groups).agg(F.sum("n").alias("n")).limit(MAX_GROUPS + 1).collect()
    return {tuple(r[c] for c in groups): r["n"] for r in rows}


def _locate(level: DataFrame, fields: list, wanted: Mapping) -> dict:
    """For each cut: the value its last row falls on, rows wanted of that value, rows on it."""
    groups = [f.name for f in fields]
    cuts = level.sparkSession.createDataFrame(
        [(*group, cut, parent, rank) for (group, cut), (parent, rank) in wanted.items()],
        T.StructType(
            [
                *fields,
                T.StructField("cut", T.IntegerType()),
                T.StructField("parent", T.StringType()),
                T.StructField("rank", T.LongType()),
            ]
        ),
    )
    match = [level[c].eqNullSafe(cuts[c]) for c in [*groups, "parent"]]
    joined = level.join(F.broadcast(cuts), match).select(*[cuts[c] for c in cuts.columns], "value", "n")
    order = Window.partitionBy(*groups, "cut").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("upto") - F.col("n")
    hits = (
        joined.withColumn("upto", F.sum("n").over(order))
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > before))
        .select(*groups, "cut", "value", (F.col("rank") - before).alias("want"), "n")
        .collect()
    )
    return {(tuple(r[c] for c in groups), r["cut"]): (r["value"], r["want"], r["n"]) for r in hits}


def _part(width: int, copy: Column | None = None) -> Column:
    """Number of the first limit a row is inside of."""
    part = F.size("_limits")
    for cut in reversed(range(width)):
        limit = F.get("_limits", F.lit(cut))
        digits = F.substring(F.col("_code"), F.lit(1), F.length(limit["upto"]))
        on_limit = limit["copies"].isNull() if copy is None else limit["copies"].isNull() | (copy <= limit["copies"])
        inside = (digits < limit["upto"]) | ((digits == limit["upto"]) & on_limit)
        part = F.when((F.size("_limits") > cut) & inside, F.lit(cut)).otherwise(part)
    return F.when(F.col("_limits").isNotNull(), part).cast("int")


def copy_numbers(copies: DataFrame, groups: list[str], out: str) -> DataFrame:
    """Add ``out``: the rows of each group numbered 1..n, without bringing a group into one task. The rows are written once."""
    part, n, ahead = (unused_name(c, copies.columns) for c in ("slice", "slice_rows", "slice_ahead"))
    written = reliable_checkpoint(copies.withColumn(part, F.spark_partition_id()))
    keys = [*groups, part]
    counts = written.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    named = {c: unused_name(f"of_{c}", copies.columns) for c in keys}
    offsets = counts.select(*[F.col(c).alias(named[c]) for c in keys], F.coalesce(F.sum(n).over(before), F.lit(0)).alias(ahead))
    match = [F.col(c).eqNullSafe(F.col(named[c])) for c in keys]
    joined = written.join(F.broadcast(offsets), match).drop(*named.values())
    local = Window.partitionBy(*keys).orderBy(groups[-1])
    return joined.withColumn(out, F.col(ahead) + F.row_number().over(local)).drop(ahead, part)
