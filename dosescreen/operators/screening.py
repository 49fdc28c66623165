"""The integrated table: potency, exposure and evidence side by side, filtered, ranked and prioritised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import numeric as num
from dosescreen.functions import text as txt
from dosescreen.functions.rules import flag_number
from dosescreen.operators import assay, ranking
from dosescreen.operators.aggregates import count_by, distinct_by
from dosescreen.operators.joins import join_on, with_membership
from dosescreen.operators.quality import Audit
from dosescreen.operators.reshape import explode_tokens, pick, quoted, rename, to_front, unpivot_groups


def ac50_label(value: Column) -> Column:
    """``-`` where not active, a blank where not tested, else the number as text."""
    return F.when(value == fixed.NOT_ACTIVE, F.lit("-")).when(value.isNull(), F.lit(" ")).otherwise(
        num.number_text(value)
    )


def mammary_label(listed_as: Column, pesticide_status: Column) -> Column:
    """Effect on the mammary gland: the list label, else the pesticide label with its note, else NULL."""
    listed = txt.abbreviate(F.nullif(listed_as, F.lit("")), fixed.MAMMARY_LABELS)
    effect = txt.recode(pesticide_status, fixed.PESTICIDE_EFFECTS)
    known = txt.in_values(pesticide_status, fixed.PESTICIDE_EFFECTS)
    return F.coalesce(listed, F.when(known, F.concat(effect, F.lit(fixed.PESTICIDE_EFFECT_NOTE))))


def integrated_long(
    potency: DataFrame, areas: DataFrame, sources: DataFrame, pesticides: DataFrame, evidence: DataFrame,
    channels: list[str] | None = None, measures: tuple[str, ...] = ("LEC", "MFC", "hits", "AC50"),
    audit: Audit | None = None,
) -> DataFrame:
    """One row per chemical and hormone with receptor areas, exposure sources and in-vivo evidence beside it.

    ``areas`` (CASRN, AUC.Agonist, AUC.Antagonist, AUC.Bioactivity as text), ``sources`` (casrn, ...), ``pesticides``
    (CASRN, status) and ``evidence`` (casn, ...) have one row per chemical. With ``audit`` the rows beside the areas and
    those of the result are counted as ``with_areas`` and ``integrated``.
    """
    long = unpivot_groups(potency, channels or fixed.CHANNELS, list(measures), "hormone")
    long = long.where(F.col("LEC").isNotNull()).drop("date_chnm_plate", "plate")
    long = long.withColumn("AC50", ac50_label(F.col("AC50")))
    joined = join_on(long, areas, {"casn": "CASRN"})
    if audit:
        joined = audit.watch(joined, "with_areas")
    joined = join_on(joined, sources, {"casn": "casrn"})
    joined = join_on(joined, pick(pesticides, ["CASRN", "status"]), {"casn": "CASRN"})
    joined = join_on(joined, evidence.drop("chnm"), ["casn"])
    if audit:
        joined = audit.watch(joined, "integrated")
    labelled = joined.withColumn("Effects on mammary gland", mammary_label(F.col(fixed.MAMMARY_COLUMN), F.col("status")))
    return rename(labelled.drop(fixed.MAMMARY_COLUMN, "status"), fixed.INTEGRATED_NAMES)


def potency_filter(
    table: DataFrame, min_fold: float = fixed.MIN_FOLD_CHANGE, max_conc: float = fixed.MAX_EFFECTIVE_CONC,
    min_distance: float = fixed.MIN_DISTANCE, exclude=None, chem: str = "CASN", fold: str = "MFC", conc: str = "LEC",
    distance: str | None = "Adj.maxmMd",
) -> DataFrame:
    """Effective and potent rows, without the excluded ids. NULL measures are dropped, NULL ids are kept."""
    test = (quoted(fold) >= min_fold) & (quoted(conc) <= max_conc)
    if distance:
        test = test & (quoted(distance) > min_distance)
    kept = table.where(test & ~txt.in_values(quoted(chem), fixed.HORMONE_IDS if exclude is None else exclude))
    return kept.withColumn("logLEC", num.log10(quoted(conc)))


def display_name(name: Column, synonyms=None, abbreviations=None) -> Column:
    """Short display name: a synonym for the whole name, then abbreviations inside it."""
    recoded = txt.recode(name, fixed.SYNONYMS if synonyms is None else synonyms)
    return txt.abbreviate(recoded, fixed.ABBREVIATIONS if abbreviations is None else abbreviations)


def potency_rank(
    table: DataFrame, group: str = "hormone", chem: str = "CASN", fold: str = "MFC", conc: str = "LEC", cuts=None,
    tie_order: list[str] | None = None,
) -> DataFrame:
    """Percent ranks of efficacy and potency, their mean, the row's place, its share and the cluster.

    Equal scores are ordered by falling fold change and then by ``tie_order`` (the id unless given). ``table`` is read
    several times; if it is costly to compute, pass it through ``session.cut_lineage`` first.
    """
    ranked = ranking.percent_rank(table, [group], {f"rank_{fold}": (fold, False), f"rank_{conc}": (conc, True)})
    scored = ranked.withColumn(
        "cumulative_rank", (quoted(f"rank_{fold}") + quoted(f"rank_{conc}")) / 2
    )
    order = [ranking.Descending("cumulative_rank"), ranking.Descending(quoted(fold)),
             *[quoted(c) for c in tie_order or [chem]]]
    placed = ranking.positions(scored, [group], order, "rank", "__rows")
    share = placed.withColumn("rank_percent", F.col("rank") / F.col("__rows")).drop("__rows")
    return share.withColumn("cluster", ranking.share_class(F.col("rank_percent"), cuts or fixed.CLUSTERS))


def annotate(table: DataFrame, assay_calls: DataFrame, ranks: DataFrame) -> DataFrame:
    """Add AC10, cluster, place, synonym and the failed-candidate flag; front columns first.

    ``assay_calls`` (casn, hormone, AC10, hitcall) and ``ranks`` (CASN, hormone, Synonym, cluster, rank, rank_percent)
    have one row per chemical and hormone.
    """
    calls = pick(assay_calls, ["casn", "hormone", "AC10", "hitcall"])
    joined = join_on(table, calls, {"CASN": "casn", "hormone": "hormone"})
    joined = joined.withColumn("AC10", assay.active_label(F.col("AC10"), F.col("hitcall"))).drop("hitcall")
    placed = join_on(
        joined, pick(ranks, ["Synonym", "CASN", "cluster", "rank", "rank_percent", "hormone"]), ["CASN", "hormone"]
    )
    name = quoted("Chemical name")
    named = placed.withColumn(
        "Synonym", F.when(name != F.col("Synonym"), F.col("Synonym")).otherwise(F.lit(""))
    ).withColumn("Failed drug candidate", failed_candidate(name))
    fronted = to_front(named, [
        "hormone", "Chemical name", "Synonym", "CASN", "cluster", "rank", "rank_percent", "MFC", "AC50", "AC10", "hits",
    ])
    return rename(fronted, {
        "cluster": "Efficacy/potency", "AUC.Bioactivity": "ER_Bioactivity", "AUC.Agonist": "ER_Agonist_AUC",
        "AUC.Antagonist": "ER_Antagonist_AUC",
    })


def failed_candidate(name: Column, pattern: str = fixed.DRUG_CANDIDATE) -> Column:
    return flag_number(txt.matches(name, pattern))


def ingredient_counts(
    products: DataFrame, ingredient: str = "Ingredient", kind: str = "Type", separator: str = fixed.INGREDIENT_SEPARATOR,
    discontinued: str = fixed.DISCONTINUED,
) -> DataFrame:
    """How often each lower-case ingredient occurs in products that are not discontinued."""
    sold = products.where(quoted(kind) != discontinued).select(F.lower(quoted(ingredient)).alias("__list"))
    tokens = explode_tokens(sold, "__list", separator, "ingredients")
    return count_by(tokens.where(F.col("ingredients") != ""), ["ingredients"], "n")


def ingredient_match(table: DataFrame, counts: DataFrame, chem: str = "CASN", name: str = "Chemical name") -> DataFrame:
    """Distinct chemicals with the number of products that list their name as an ingredient."""
    chemicals = distinct_by(table, [name, chem]).withColumn("Chemical name2", F.lower(quoted(name)))
    return join_on(chemicals, counts, {"Chemical name2": "ingredients"})


def active_products(table: DataFrame, status: DataFrame, chem: str = "CASN", name: str = "Chemical name") -> DataFrame:
    """Distinct chemicals with ``products`` = yes (some active), no (only inactive) or empty (none)."""
    chemicals = distinct_by(table, [name, chem])
    joined = join_on(chemicals, pick(status, [chem, "Active products", "Not active products"]), [chem])
    return joined.withColumn(
        "products",
        F.when(quoted("Active products").isNotNull(), F.lit("yes"))
        .when(quoted("Not active products").isNotNull(), F.lit("no")).otherwise(F.lit("")),
    )


def prioritise(
    table: DataFrame, ingredients: DataFrame, pesticides: DataFrame, chem: str = "CASN", name: str = "Chemical name",
    cluster: str = "Efficacy/potency", consumer: str = "Consumer", survey: str = "Nhanes",
) -> DataFrame:
    """Add the two product columns and the priority: clustered and with at least one sign of exposure.

    A predicted consumer use (``1*``) is no sign; a NULL sign counts as absent unless another one is present.
    """
    marked = with_membership(
        table.withColumn("__name", F.lower(quoted(name))), "__name", {"__fda": (ingredients, "ingredients")}
    )
    marked = with_membership(
        marked, chem, {"__epa": (pesticides.where(F.col("products") == "yes"), chem)}
    )
    def label(test: Column) -> Column:
        return F.when(test, F.lit("yes")).otherwise(F.lit("no"))

    exposed = (quoted(consumer) == "1") | (quoted(survey) == 1) | F.col("__epa") | F.col("__fda")
    out = marked.withColumns({
        "FDA approved drug products": label(F.col("__fda")),
        "EPA approved pesticide products": label(F.col("__epa")),
        fixed.PRIORITY: label((quoted(cluster) != "") & exposed),
    })
    return to_front(out.drop("__name", "__fda", "__epa"), [name, chem])


def override_labels(cluster: Column, chem: Column, substrates=None) -> Column:
    """Hormones are substrates; what has no cluster is borderline active."""
    return F.when(
        txt.in_values(chem, fixed.HORMONE_IDS if substrates is None else substrates), F.lit(fixed.SUBSTRATE_LABEL)
    ).otherwise(F.coalesce(cluster, F.lit(fixed.BORDERLINE_LABEL)))


def final_tables(table: DataFrame, substrates: list[str] | None = None) -> dict[str, DataFrame]:
    """The published table of each hormone: fixed names and column order, the other hormone's direction renamed."""
    fixed_spelling = {fixed.TOXICITY_SUMMARY: "Developmental or reproductive toxicity (Summary)"}
    named = rename(rename(table, fixed_spelling), fixed.PUBLISHED_NAMES)
    laid_out = pick(named, fixed.PUBLISHED_COLUMNS).withColumn(
        "Efficacy/potency", override_labels(quoted("Efficacy/potency"), F.col("CASN"), substrates)
    )
    out = {}
    for hormone, other in ((fixed.ESTRADIOL, fixed.PROGESTERONE), (fixed.PROGESTERONE, fixed.ESTRADIOL)):
        one = laid_out.where(F.col("hormone") == hormone).drop("hormone", hormone)
        out[hormone] = one.withColumnRenamed(other, fixed.DIRECTION_NAMES[other])
    return out
