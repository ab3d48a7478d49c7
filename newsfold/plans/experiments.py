"""Runs: which languages train and test, and the splits of all runs at once."""

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfold import fixed_values as V
from newsfold.operators.hash_order import hash_order, mark_smallest
from newsfold.operators.metrics import macro_from_pairs, pair_counts
from newsfold.operators.split import class_quotas, label_counts_by, train_val_test_quotas


@dataclass(frozen=True)
class Run:
    """One experiment. With ``held_out`` all other languages form the test part."""

    name: str
    family: str
    langs: tuple[str, ...]
    held_out: bool = False


def resolve_run(
    names: Sequence[str],
    family: str,
    multilingual: bool = False,
    held_out: bool = False,
    codes: Mapping[str, str] = V.LANGUAGE_CODES,
) -> Run:
    """Run of the named languages; unknown names are ignored, none left is an error."""
    langs = tuple(codes[n] for n in names if n in codes)
    if not langs:
        raise ValueError(f"no language found in {list(names)}")
    if not multilingual and len(langs) == 1:
        name = f"{langs[0]}-{family}"
    elif set(langs) == set(codes.values()):
        name = f"m-{family}-all"
    else:
        name = f"m-{family}-{'-'.join(langs)}"
    return Run(name, family, langs, held_out)


def standard_runs() -> list[Run]:
    """The 4 SVM runs and the 10 transformer runs."""
    en, nl, it = "English", "Dutch", "Italian"
    runs = [resolve_run([lang], "svm") for lang in (en, nl, it)] + [resolve_run([en, it, nl], "svm", True)]
    runs += [resolve_run([lang], "bert") for lang in (en, nl, it)] + [resolve_run([en, it, nl], "bert", True)]
    for langs in ([en], [nl], [it], [it, en], [nl, en], [it, nl]):
        runs.append(resolve_run(langs, "bert", multilingual=True, held_out=True))
    return runs


def grid_quotas(
    df: DataFrame, runs: Sequence[Run], label: str = "is_sarcastic", fraction: float = V.HOLDOUT_FRACTION
) -> tuple[dict, list, dict]:
    """Rows by language and label, the (run, language, is it trained on) of all runs, and the quotas of (run, True, label)."""
    counts = defaultdict(lambda: defaultdict(int))
    known = {}
    for row in label_counts_by(df.filter(F.col("lang").isNotNull()), ["lang", label]):
        known.setdefault(row["lang"], {})[row[label]] = row["n"]
    members, quotas = [], {}
    for run in runs:
        for lang, by_label in known.items():
            inside = lang in run.langs
            if inside or run.held_out:
                members.append((run.name, lang, inside))
            if inside:
                for value, n in by_label.items():
                    counts[run.name][value] += n
        pool = counts[run.name]
        if run.held_out:
            quotas.update({(run.name, True, v): [0, n] for v, n in class_quotas(pool, fraction).items()})
        else:
            quotas.update({(run.name, True, v): q for v, q in train_val_test_quotas(pool, fraction).items()})
    return known, members, quotas


def experiment_grid(
    df: DataFrame,
    runs: Sequence[Run],
    key: str = "article_url",
    label: str = "is_sarcastic",
    fraction: float = V.HOLDOUT_FRACTION,
    seed: int = V.SEED,
) -> DataFrame:
    """Rows of every run with their ``run`` and ``split``; a row may be in many runs.

    The rows are counted by language and label before they are repeated per run,
    and all runs share one hash order, so the grid costs little more than one split.
    Rows without a language are in no run.
    """
    _, members, quotas = grid_quotas(df, runs, label, fraction)
    table = df.sparkSession.createDataFrame(members, "run string, lang string, _pool boolean")
    marked = mark_smallest(df, ["run", "_pool", label], quotas, hash_order(seed, key), "_part", table, ["lang"])
    names = F.get(F.array(F.lit("test"), F.lit("val"), F.lit("train")), F.col("_part"))
    return marked.withColumn("split", F.when(F.col("_pool"), names).otherwise("test")).drop("_part", "_pool")


def transfer_matrix(
    predictions: DataFrame, zero_division: float = 0.0, y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """Macro scores of each run on each test language (columns run and lang)."""
    by = ("run", "lang")
    return macro_from_pairs(pair_counts(predictions, y, p, by), zero_division, by)


def trained_and_unseen(
    predictions: DataFrame,
    runs: Sequence[Run],
    zero_division: float = 0.0,
    y: str = "y_true",
    p: str = "y_pred",
) -> DataFrame:
    """Macro scores per run over its own ("eval") and over all other languages ("test").

    For predictions of one model per row: the rows are counted by language once,
    and only the counts are repeated per run.
    """
    pairs = pair_counts(predictions.filter(F.col("lang").isNotNull()), y, p, ["lang"])
    table = predictions.sparkSession.createDataFrame(
        [(run.name, list(run.langs)) for run in runs], "run string, langs array<string>"
    )
    each = pairs.withColumn("_run", F.explode(F.lit([r.name for r in runs])))
    each = each.join(F.broadcast(table), F.col("_run") == F.col("run"))
    each = each.withColumn("split", F.when(F.array_contains("langs", F.col("lang")), "eval").otherwise("test"))
    by = ("run", "split")
    summed = each.groupBy(*by, "y", "p").agg(F.sum("n").alias("n"))
    return macro_from_pairs(summed, zero_division, by)
