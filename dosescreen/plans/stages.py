"""The four stages of the analysis, each from tables to tables.

Nothing is written between stages; pass the result of one to the next, or land it with ``sources.writers.write_stage``.
Key columns of all joins are written out. Checks are not made unless ``check`` is set: then the stage's table is written,
and what the joins rely on is counted in the same pass (see :class:`~dosescreen.operators.quality.Audit`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import numeric as num
from dosescreen.operators import assay, charts, evidence, exposure, quality, screening, statistics
from dosescreen.operators.aggregates import distinct_by, duplicated_keys
from dosescreen.operators.joins import join_on, member_of, with_membership
from dosescreen.operators.reshape import column_range, pick, quoted, rename, unpivot
from dosescreen.plans.runs import Run, Tables
from dosescreen.session import cut_lineage

PLATE = "date_chnm_plate"


def _not_unique(keys: list[str]) -> str:
    return f"keys {keys} are not unique"


def potency(
    direction: DataFrame, hits: DataFrame, concentrations: DataFrame, wells: DataFrame, distances: DataFrame,
    ac50: DataFrame, substances: DataFrame, predictions: DataFrame, check: bool = False,
    known_gaps: DataFrame | None = None, audit: quality.Audit | None = None,
) -> DataFrame:
    """Chemicals that raise a hormone: LEC, MFC, hits, tested range, directions, distance, AC50, predicted intake.

    With ``check`` the tables must have what the joins rely on; ``known_gaps`` (chnm) lists who may lack a prediction.
    ``audit`` may be given to read the counts afterwards.
    """
    audit = (audit or quality.Audit()) if check else None
    plates = [c for c in direction.columns if c != "steroid"]
    directions = assay.direction_table(direction, plates, audit=audit)
    if audit:
        several = distinct_by(directions, ["chnm", PLATE])
        audit.expect(lambda c: not c["lowest"]["ambiguous"], lambda: duplicated_keys(several, ["chnm"]), _not_unique(["chnm"]))
    channels = column_range(hits, "OH-Pregnenolone", "Estradiol")
    ids = [PLATE, "chnm", "casn"]
    slots = assay.unpack_hits(pick(hits, ids + channels), ids, channels)
    # name and id come from the hit table, the direction and the plate number from the direction table
    marked = join_on(
        pick(directions, [PLATE, "steroid", "direction", "plate"]), slots, [PLATE, "steroid"]
    )
    levels = assay.dose_levels(pick(concentrations, [PLATE, "conc"]), [PLATE], ties="__ties" if audit else None)
    if audit:
        slots = [PLATE, "dose_level"]
        levels = audit.watch(levels, "levels", tied=F.count_if(F.col("__ties") > 1)).drop("__ties")
        audit.expect(lambda c: not c["levels"]["tied"], lambda: duplicated_keys(levels, slots), _not_unique(slots))
    dosed = join_on(marked, levels, [PLATE, "dose_level"])

    tidy = assay.tidy_wells(wells)
    means = assay.collapse_replicates(
        tidy, ["steroid", "casn", "chnm", "date", "plate", "conc_index", "conc"], "uM", "flag", "uM_bar", "flag_bar"
    )
    controls = assay.collapse_replicates(
        tidy.where(F.col("spid") == fixed.CONTROL_SAMPLE), ["steroid", "date", "plate"], "uM", "flag",
        "control_bar", "control_flag_bar",
    )
    if audit:
        means = audit.watch(means, "means", unnamed=F.count_if(F.col("chnm").isNull()))
    folds = assay.fold_change(means, controls, ["steroid", "date", "plate"])
    if audit:
        changed = folds = audit.watch(folds, "folds", unnamed=F.count_if(F.col("chnm").isNull()))
        audit.expect(
            lambda c: c["means"]["unnamed"] == c["folds"]["unnamed"],
            lambda: quality.null_count(means, ["chnm"]).exceptAll(quality.null_count(changed, ["chnm"])),
            "the controls change the number of wells without a name",
        )
    folds = assay.dose_levels(folds, ["casn", "steroid", "plate", "date"])
    folds = pick(folds, ["casn", "steroid", "plate", "dose_level", "foldchange"])
    doses = ["casn", "steroid", "plate", "dose_level"]
    combined = assay.signed_hits(join_on(audit.watch(dosed, "dosed") if audit else dosed, folds, doses))
    if audit:
        combined = audit.watch(combined, "combined")
        audit.same_rows("dosed", "combined", lambda: duplicated_keys(folds.where(F.col("casn").isNotNull()), doses),
                        _not_unique(doses))

    keys = [PLATE, "steroid", "direction", "plate", "chnm", "casn", "hits"]
    effects = assay.lec_mfc(combined.where(F.col("direction") == 1), keys)
    tested = assay.tested_range(pick(concentrations, [PLATE, "conc"]), [PLATE])
    ranged = join_on(effects, tested, [PLATE])
    chosen = assay.responders(
        ranged, directions, [PLATE, "plate", "chnm", "casn", "max_tested_conc", "min_tested_conc"], "chnm",
        fixed.CHANNELS,
    )
    distanced = assay.attach_distance(chosen, distances, [PLATE, "chnm", "casn"], "adj_maxmMD")
    if audit:
        distanced = audit.watch(distanced, "distanced")
        coded = join_on(pick(ac50, ["code"]), pick(substances, ["code", "casn"]), ["code"], "inner")
        codes = lambda: duplicated_keys(substances, ["code"])
        names = lambda: duplicated_keys(member_of(coded, "casn", distanced, "casn"), ["casn"])
        for findings, key in ((codes, "code"), (names, "casn")):
            audit.same_rows("distanced", "measured", findings, _not_unique([key]))
    measured = assay.attach_matrix(
        distanced, ac50, substances, {c: f"AC50_{h}" for c, h in fixed.MATRIX_COLUMNS.items()}
    ).drop("adj_maxmMD_text", *[f"AC50_{h}_text" for h in fixed.CHANNELS])
    if audit:
        measured = audit.watch(measured, "measured")
    renamed = predictions.withColumn("chnm", assay.clean_names(F.col("Substance_Name")))
    potent = assay.attach_prediction(measured, renamed, {"casn": "CAS", "chnm": "chnm"}, keep=("Pathway",))
    if not audit:
        return potent
    known = with_membership(potent, "chnm", {"__known": (known_gaps if known_gaps is not None else potent.limit(0), "chnm")})
    watched = audit.watch(known, "potent", gaps=F.count_if(F.col("seem3").isNull() & ~F.col("__known"))).drop("__known")
    if known_gaps is not None:
        audit.expect(lambda c: not c["potent"]["gaps"], lambda: quality.unexpected_nulls(potent, "seem3", "chnm", known_gaps, "chnm"),
                     "chemicals without a prediction that are not known gaps")
    return audit.settled(watched)


def sources(
    potent: DataFrame, ids: DataFrame, paths: DataFrame, products: DataFrame, ingredients: DataFrame,
    predictions: DataFrame,
) -> dict[str, DataFrame]:
    """Exposure sources of the responders: ``specific`` has a row per use, ``tidy`` a row per chemical."""
    universe = distinct_by(potent, ["casn"])
    records = exposure.catalogue_records(paths, ids, universe)
    uses = exposure.product_uses(ids, ingredients, products, universe)
    table = exposure.with_predictions(
        exposure.source_summary(records, uses), universe, distinct_by(predictions, ["CAS", "Pathway"])
    )
    # one row per chemical, read by both results
    narrow = cut_lineage(table.drop("broad", "Pathway", fixed.UNCATEGORISED))
    return {"specific": exposure.tokens_to_rows(narrow), "tidy": exposure.tidy_sources(narrow)}


def invivo(
    potent: DataFrame, studies: DataFrame, cancer_calls: DataFrame, developmental: DataFrame, carcinogens: DataFrame,
    survey: DataFrame, listed: DataFrame, call_sources: list[str],
) -> dict[str, DataFrame]:
    """In-vivo evidence of the responders: ``matrix`` and ``calls`` have a row per chemical."""
    chemicals = distinct_by(potent, ["chnm", "casn"])
    classified = evidence.classify_studies(evidence.restrict_to(studies, "casrn", chemicals))
    calls = evidence.restrict_to(cancer_calls, "casrn", chemicals)
    matrix = evidence.evidence_matrix(
        chemicals, evidence.evidence_flags(classified), evidence.call_classes(calls),
        evidence.list_flags(evidence.clean_list(listed)), survey, developmental, carcinogens,
    )
    return {
        "matrix": evidence.evidence_summary(matrix),
        "calls": evidence.calls_by_source(calls, call_sources),
    }


def integration(
    potent: DataFrame, tidy_sources: DataFrame, evidence_matrix: DataFrame, areas: DataFrame, pesticides: DataFrame,
    ac10: DataFrame, hit_calls: DataFrame, substances: DataFrame, drug_products: DataFrame, pesticide_status: DataFrame,
    uses: DataFrame | None = None, check: bool = False, audit: quality.Audit | None = None,
) -> dict[str, DataFrame]:
    """Integrated, ranked and prioritised tables, the two published ones, correlations and the tables behind the charts.

    ``uses`` is ``specific`` of :func:`sources`; without it there is no ``use_counts``.
    """
    audit = (audit or quality.Audit()) if check else None
    labelled = assay.label_areas(
        areas.withColumnRenamed("CASRN_Adj (4-30-21)", "CASRN"), "CASRN", "AUC.Agonist", "AUC.Antagonist"
    )
    # read by five of the results below, and the ranking reads its input several times
    table = cut_lineage(screening.integrated_long(potent, labelled, tidy_sources, pesticides, evidence_matrix, audit=audit))
    if audit:
        for side, key in ((tidy_sources, "casrn"), (evidence_matrix, "casn"), (pesticides, "CASRN")):
            audit.same_rows("with_areas", "integrated", lambda s=side, k=key: duplicated_keys(s, [k]), _not_unique([key]))
        audit.verify()
    filtered = screening.potency_filter(table).withColumns({
        "seem": num.parse_number(quoted(fixed.INTAKE)),
        "Chemical name": screening.display_name(quoted("Chemical name")),
    })
    ranked = cut_lineage(screening.potency_rank(
        cut_lineage(pick(filtered, ["hormone", "Chemical name", "CASN", "MFC", "LEC", "logLEC"]))
    ))
    assay_calls = assay.matrix_with_calls(ac10, hit_calls, substances)
    points = join_on(
        table.select(
            quoted("Chemical name"), "CASN", "hormone",
            num.log10(num.to_number("AC50")).alias("AC50_active"), num.log10("LEC").alias("LEC"),
        ),
        pick(assay_calls, ["casn", "hormone", "AC10", "hitcall"]), {"CASN": "casn", "hormone": "hormone"},
    )
    points = points.withColumn("AC10_active", assay.active_value(F.col("AC10"), F.col("hitcall")))
    points = join_on(
        rename(points, {"AC10": "AC10_all"}), distinct_by(ranked, ["CASN", "hormone"]), ["CASN", "hormone"], "left_semi"
    )
    long = unpivot(points, ["hormone", "LEC"], ["AC50_active", "AC10_all", "AC10_active"], "POD", "value")
    updated = cut_lineage(screening.annotate(table, assay_calls, rename(ranked, {"Chemical name": "Synonym"})))
    ingredients = screening.ingredient_counts(drug_products)
    status = screening.active_products(updated, pesticide_status)
    prioritised = cut_lineage(screening.prioritise(updated, ingredients, status))
    published = screening.final_tables(prioritised)
    plotted = charts.plotted(ranked)
    keys = ["Chemical name", "CASN"]
    reported = charts.source_long(updated.where(quoted("Efficacy/potency").isNotNull()), keys)
    figures = {
        "correlations": statistics.pearson_test(long, ["hormone", "POD"], "LEC", "value"),
        "bands": statistics.regression_band(long, ["hormone", "POD"], "LEC", "value"),
        "cluster_sizes": charts.cluster_sizes(plotted), "labels": charts.label_window(plotted),
        "exposure_bins": charts.exposure_bins(charts.hormone_sets(updated, [*keys, fixed.INTAKE])),
        "source_counts": charts.source_hormone_counts(reported, keys),
    }
    if uses is not None:
        figures["use_counts"] = charts.use_hormone_counts(uses, reported, "casrn", keys, "CASN")
    return {
        "table": table, "ranked": ranked, "points": points, "updated": updated, "ingredients": ingredients,
        "pesticide_products": status, "prioritised": prioritised, **published, **figures,
    }


def study(run: Run, first: Tables, exposures: Tables, findings: Tables, rest: Tables, call_sources: list[str],
          version: str = "1") -> dict[str, Tables]:
    """All four stages, each resumed where ``run`` has complete tables of it.

    ``first``, ``exposures``, ``findings`` and ``rest`` hold the inputs of :func:`potency`, :func:`sources`, :func:`invivo`
    and :func:`integration` by the names of their arguments, without what earlier stages give.
    """
    potent = run.stage("potency", first, lambda: {"potent": potency(**first, check=True)}, version)
    used = run.stage("sources", potent | exposures, lambda: sources(potent["potent"], **exposures), version)
    seen = run.stage("invivo", potent | findings, lambda: invivo(potent["potent"], **findings, call_sources=call_sources),
                     f"{version} {call_sources}")
    given = {"potent": potent["potent"], "tidy_sources": used["tidy"], "evidence_matrix": seen["matrix"], "uses": used["specific"]}
    return {"potency": potent, "sources": used, "invivo": seen,
            "integration": run.stage("integration", given | rest, lambda: integration(**given, **rest, check=True), version)}
