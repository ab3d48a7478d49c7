"""All runs over one pass of the rows: bit i of a mask stands for run i.

``experiments.experiment_grid`` repeats a row for each run it is in. Here a row stays one row and carries three masks:
the runs it trains, validates and tests. Counts (of labels, terms or predictions) are summed once per mask, which is far
fewer rows than the table has, and only the sums are repeated per run.
"""

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfold import fixed_values as V
from newsfold.operators.features import max_features_for, term_counts
from newsfold.operators.hash_order import KEY, copy_numbers, find_limits, hash_order, row_digest
from newsfold.operators.metrics import macro_from_pairs
from newsfold.plans.experiments import Run, grid_quotas
from newsfold.session import unused_name

#: Bits of a mask.
MAX_RUNS = 62
TRAIN, VAL, TEST = "train_of", "val_of", "test_of"

_LIMIT = T.StructType([T.StructField("upto", T.StringType()), T.StructField("copies", T.LongType())])


def _check(runs: Sequence[Run]) -> None:
    names = [run.name for run in runs]
    if len(names) > MAX_RUNS or len(set(names)) < len(names):
        raise ValueError(f"need at most {MAX_RUNS} runs, each with a name of its own; pass more in several calls")


def split_masks(
    df: DataFrame,
    runs: Sequence[Run],
    key: str = "article_url",
    label: str = "is_sarcastic",
    fraction: float = V.HOLDOUT_FRACTION,
    seed: int = V.SEED,
) -> DataFrame:
    """Add ``train_of``, ``val_of`` and ``test_of``: masks of the runs in which the row is in that part.

    The parts are those of ``experiment_grid``; no row is repeated or shuffled. Rows without a language are in no run.
    Rows of equal key are told apart by their other columns; of full copies, some may fall on either side of a limit.
    """
    _check(runs)
    known, members, quotas = grid_quotas(df, runs, label, fraction)
    spark = df.sparkSession
    order = hash_order(seed, key)
    run_name, pool = (unused_name(n, df.columns) for n in ("run_name", "run_pool"))
    lookup = spark.createDataFrame(members, f"`{run_name}` string, lang string, `{pool}` boolean")
    limits = find_limits(df, [run_name, pool, label], quotas, order, lookup, ["lang"])[2] if quotas else {}
    inside = defaultdict(list)
    unseen = defaultdict(int)
    for i, run in enumerate(runs):
        for lang, by_label in known.items():
            for value in by_label:
                if lang in run.langs:
                    group = (run.name, True, value)
                    inside[lang, value].append((1 << i, limits[group, 0], limits[group, 1]))
                elif run.held_out:
                    unseen[lang, value] |= 1 << i
    lang, value, places, others, code = (
        unused_name(n, df.columns) for n in ("run_lang", "run_label", "run_places", "run_others", "run_code")
    )
    place = T.StructType([T.StructField("bit", T.LongType()), T.StructField("test", _LIMIT), T.StructField("val", _LIMIT)])
    fields = [
        T.StructField(lang, T.StringType()),
        T.StructField(value, df.schema[label].dataType),
        T.StructField(places, T.ArrayType(place)),
        T.StructField(others, T.LongType()),
    ]
    both = [(a, b) for a, by_label in known.items() for b in by_label]
    table = spark.createDataFrame([(a, b, inside[a, b], unseen[a, b]) for a, b in both], T.StructType(fields))
    needs_row = any(len(upto) > KEY for upto, _ in limits.values())
    placed = df.withColumn(code, F.concat(order, row_digest(df)) if needs_row else order)
    match = (placed["lang"] == table[lang]) & placed[label].eqNullSafe(table[value])
    placed = placed.join(F.broadcast(table), match, "left").drop(lang, value)
    made = [places, others, code]
    if all(copies is None for _, copies in limits.values()):
        return _with_masks(placed, code, places, others, None).drop(*made)
    on_limit = F.exists(places, lambda p: _splits_copies(p["test"], code) | _splits_copies(p["val"], code))
    is_copy = F.coalesce(on_limit, F.lit(False))
    copy = unused_name("run_copy", df.columns)
    numbered = copy_numbers(placed.filter(is_copy), [code], copy)
    marked = _with_masks(numbered, code, places, others, copy).drop(*made, copy)
    return _with_masks(placed.filter(~is_copy), code, places, others, None).drop(*made).unionByName(marked)


def _splits_copies(limit: Column, code: str) -> Column:
    return limit["copies"].isNotNull() & (limit["upto"] == F.col(code))


def _with_masks(placed: DataFrame, code: str, places: str, others: str, copy: str | None) -> DataFrame:
    def under(limit: Column) -> Column:
        digits = F.substring(F.col(code), F.lit(1), F.length(limit["upto"]))
        whole = limit["copies"].isNull()
        whole = whole if copy is None else whole | (F.col(copy) <= limit["copies"])
        return (digits < limit["upto"]) | ((digits == limit["upto"]) & whole)

    def bits(chosen) -> Column:
        zero = F.lit(0).cast("long")
        summed = F.aggregate(places, zero, lambda mask, p: mask + F.when(chosen(p), p["bit"]).otherwise(zero))
        return F.coalesce(summed, zero)

    return placed.withColumns(
        {
            TRAIN: bits(lambda p: ~under(p["val"])),
            VAL: bits(lambda p: under(p["val"]) & ~under(p["test"])),
            TEST: bits(lambda p: under(p["test"])).bitwiseOR(F.coalesce(others, F.lit(0).cast("long"))),
        }
    )


def has_run(mask: Column | str, run: Column) -> Column:
    """Is the bit of run number ``run`` set?"""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.call_function("shiftright", mask, run.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def per_run(counts: DataFrame, runs: Sequence[Run], mask: str) -> DataFrame:
    """Each row once for every run in its mask, with ``run`` (its name) and ``run_number`` before the other columns."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(len(runs) - 1)), lambda i: has_run(mask, i))
    names = F.array(*[F.lit(run.name) for run in runs])
    repeated = counts.select(F.explode(numbers).alias("run_number"), *[c for c in counts.columns if c not in ("run", "run_number")])
    return repeated.select(F.get(names, F.col("run_number")).alias("run"), "*")


def label_counts_by_run(masked: DataFrame, runs: Sequence[Run], label: str = "is_sarcastic") -> DataFrame:
    """run, split, label and ``n``, from one count of the rows per mask."""
    _check(runs)
    parts = F.explode(F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for n in (TRAIN, VAL, TEST) for i, x in enumerate((n[: -len("_of")], n))]))
    once = masked.groupBy(TRAIN, VAL, TEST, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    each = per_run(once.select("label", "n", parts.alias("split", "mask")), runs, "mask")
    return each.groupBy("run", "split", F.col("label").alias(label)).agg(F.sum("n").alias("n"))


def term_counts_by_run(masked: DataFrame, runs: Sequence[Run], text: str = "article_title", mask: str = TRAIN) -> DataFrame:
    """run, term, ``n`` and ``docs`` over the rows of each run; the texts are split once, not once a run."""
    _check(runs)
    once = term_counts(masked.filter(F.col(mask) != 0), text, by=[mask])
    return per_run(once, runs, mask).groupBy("run", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabularies(
    masked: DataFrame, runs: Sequence[Run], text: str = "article_title", mask: str = TRAIN, sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """run, term, ``n`` and ``docs`` of each run's most frequent terms, equal counts by term.

    ``sizes``: terms by name of the run, else as ``max_features_for`` says. A task hands on no more terms of a run than
    its vocabulary has.
    """
    counts = term_counts_by_run(masked, runs, text, mask)
    most = {run.name: max_features_for(run.langs) for run in runs} | dict(sizes or {})
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("n"), "term"))
    ranked = counts.withColumn("rank", rank).filter(F.col("rank") <= max(most.values(), default=0))
    size = F.element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("run")) if most else F.lit(0)
    return ranked.filter(F.col("rank") <= size).drop("rank")


def predict_all(df: DataFrame, models: Sequence, out: str = "predicted_of") -> DataFrame:
    """Add ``out``: bit i is the prediction of model i, a pair of its text pipeline and its SVM. One pass, no shuffle.

    Columns that the models make for themselves (features, scores) go again.
    """
    if len(models) > MAX_RUNS:
        raise ValueError(f"at most {MAX_RUNS} models")
    scored = df.withColumn(out, F.lit(0).cast("long"))
    for i, (text_model, model) in enumerate(models):
        found = model.transform(text_model.transform(scored))
        bit = F.when(F.col("prediction") == 1, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        scored = found.withColumn(out, F.col(out) + bit).select(*df.columns, out)
    return scored


def pairs_by_run(
    masked: DataFrame,
    runs: Sequence[Run],
    predicted: str = "predicted_of",
    y: str = "is_sarcastic",
    by: Sequence[str] = ("lang",),
    mask: str = TEST,
) -> DataFrame:
    """run, ``by``, y, p and ``n``: labels against predictions, rows counted once per mask and mask of predictions.

    Predictions of runs that the row isn't in are left out of the count's key. Rows without a label are left out.
    """
    _check(runs)
    used = F.col(predicted).bitwiseAND(F.col(mask)).alias("predicted")
    rows = masked.filter((F.col(mask) != 0) & F.col(y).isNotNull())
    once = rows.groupBy(*by, F.col(mask).alias("mask"), used, F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    each = per_run(once, runs, "mask").withColumn("p", has_run("predicted", F.col("run_number")).cast("int"))
    return each.groupBy("run", *by, "y", "p").agg(F.sum("n").alias("n"))


def transfer_of_runs(
    masked: DataFrame,
    runs: Sequence[Run],
    zero_division: float = 0.0,
    predicted: str = "predicted_of",
    y: str = "is_sarcastic",
    by: Sequence[str] = ("lang",),
) -> DataFrame:
    """Macro scores of every run on its test rows in each language, from one count."""
    return macro_from_pairs(pairs_by_run(masked, runs, predicted, y, by), zero_division, ["run", *by])
