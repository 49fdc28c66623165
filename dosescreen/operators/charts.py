"""The tables behind the figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import numeric as num
from dosescreen.functions import text as txt
from dosescreen.operators.aggregates import collapse_all, count_by, distinct_by
from dosescreen.operators.joins import join_on
from dosescreen.operators.reshape import quoted, unpivot, widen


def ordinal(value: Column, levels: list[str]) -> Column:
    """Place of a category in its order, from 1; NULL for an unknown category."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.nullif(place, F.lit(0)).cast("int")


def plotted(ranked: DataFrame, name: str = "Chemical name", pattern: str = fixed.DRUG_CANDIDATE) -> DataFrame:
    """Ranked rows without failed drug candidates, the cluster with its order."""
    kept = ranked.where(txt.not_matches(quoted(name), pattern))
    return kept.withColumn("cluster_order", ordinal(F.col("cluster"), [n for _, n in fixed.CLUSTERS]))


def cluster_sizes(plotted_rows: DataFrame, group: str = "hormone") -> DataFrame:
    return count_by(plotted_rows, [group, "cluster"], "n")


def label_window(
    plotted_rows: DataFrame, windows: dict[str, tuple[float, float]] | None = None, group: str = "hormone",
    fold: str = "MFC", conc: str = "logLEC",
) -> DataFrame:
    """Add ``parameters``: true where a row lies in the labelled corner of its group's chart."""
    test = F.lit(False)
    for name, (highest, lowest) in (windows or fixed.LABEL_WINDOWS).items():
        inside = (quoted(fold) <= highest) & (quoted(conc) > lowest)
        test = F.when(quoted(group) == name, F.coalesce(inside, F.lit(False))).otherwise(test)
    return plotted_rows.withColumn("parameters", test)


def hormone_sets(
    table: DataFrame, keys: list[str], channels: list[str] | None = None, group: str = "hormone",
    cluster: str = "Efficacy/potency",
) -> DataFrame:
    """One row per chemical with its cluster per hormone and ``hormone`` = Both or the only one."""
    first, second = channels or fixed.CHANNELS
    wide = widen(table.where(quoted(cluster).isNotNull()), keys, group, [first, second], [cluster])
    a, b = quoted(first), quoted(second)
    return wide.withColumn(
        "hormone",
        F.when(a.isNotNull() & b.isNotNull(), F.lit("Both")).when(b.isNotNull(), F.lit(second))
        .when(a.isNotNull(), F.lit(first)).otherwise(F.lit("fix")),
    )


def exposure_bins(
    sets: DataFrame, intake: str = fixed.INTAKE, channels: list[str] | None = None, floor: float = fixed.INTAKE_FLOOR,
    bins=None,
) -> DataFrame:
    """Chemicals with a noteworthy intake: best cluster over both hormones, intake as number, and its bin."""
    first, second = channels or fixed.CHANNELS
    rate = num.parse_number(quoted(intake))
    best = None
    for _, level in fixed.CLUSTERS:
        test = F.coalesce(quoted(first) == level, F.lit(False)) | F.coalesce(quoted(second) == level, F.lit(False))
        label = F.lit(level.capitalize())
        best = F.when(test, label) if best is None else best.when(test, label)
    levels = [n.capitalize() for _, n in reversed(fixed.CLUSTERS)]
    facet = None
    for bound, name in bins or fixed.INTAKE_BINS:
        test = F.lit(True) if bound is None else F.col("intake") > bound
        facet = F.when(test, F.lit(name)) if facet is None else facet.when(test, F.lit(name))
    out = sets.withColumn("intake", rate).where(F.col("intake") >= floor).withColumn(
        "best_cluster", best.otherwise(F.lit("Fix"))
    )
    return out.withColumns({
        "cluster_order": ordinal(F.col("best_cluster"), levels),
        "facet": facet,
    }).withColumn("facet_order", ordinal(F.col("facet"), [n for _, n in reversed(bins or fixed.INTAKE_BINS)]))


def _both(hormones: Column) -> Column:
    pattern, label = fixed.BOTH_HORMONES
    return F.regexp_replace(hormones, pattern, label)


def source_long(
    table: DataFrame, keys: list[str], categories: list[str] | None = None, group: str = "hormone"
) -> DataFrame:
    """One row per chemical, hormone and exposure category that is reported or predicted."""
    categories = categories or list(fixed.SOURCE_LABELS)
    text = table.select(*[quoted(k) for k in keys + [group]], *[quoted(c).cast("string").alias(c) for c in categories])
    long = unpivot(text, keys + [group], categories, "category", "value")
    return long.where(txt.in_values("value", ["1", fixed.PREDICTED]))


def source_hormone_counts(
    sources: DataFrame, keys: list[str], group: str = "hormone", labels: dict[str, str] | None = None
) -> DataFrame:
    """Number of chemicals per exposure category and set of hormones."""
    labels = labels or fixed.SOURCE_LABELS
    sets = collapse_all(sources, keys + ["category"], group, "hormones")
    counted = count_by(sets, ["category", "hormones"], "n")
    return counted.withColumns({
        "categories": txt.recode("category", labels),
        "category_order": ordinal(F.col("category"), list(labels)),
        "Hormone_set": _both(F.col("hormones")),
    })


def use_hormone_counts(
    tokens: DataFrame, chemicals: DataFrame, token_key: str, keys: list[str], chem: str, group: str = "hormone",
    value: str = "value",
) -> DataFrame:
    """Number of chemicals per specific use and set of hormones.

    ``chemicals`` gives the hormones of each chemical that has an exposure category (see :func:`source_long`);
    ``tokens`` its uses. Chemicals without a use are left out.
    """
    single = distinct_by(chemicals, keys + [group])
    uses = tokens.where(quoted(value).isNotNull()).select(quoted(token_key), quoted(value))
    joined = join_on(uses, single, {token_key: chem}, "inner")
    names = [token_key if k == chem else k for k in keys]
    sets = collapse_all(joined, names + [value], group, "hormones")
    return count_by(sets, ["hormones", value], "n").withColumn("Hormone_set", _both(F.col("hormones")))
