"""From wells to effects: replicates, controls, dose levels, the consecutive-dose rule, LEC and MFC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosescreen import fixed_values as fixed
from dosescreen.functions import numeric as num
from dosescreen.functions import text as txt
from dosescreen.operators import ranking
from dosescreen.operators.joins import join_on
from dosescreen.operators.quality import Audit
from dosescreen.operators.reshape import explode_slots, named, pick, quoted, unpivot, widen
from dosescreen.session import cut_lineage

#: Doses of a key that stand in one row while neighbours are compared.
BLOCK = 8
PLATE_PATTERN = r"^([^_]+)_(.*)_Plate([0-9]+)$"


def plate_parts(df: DataFrame, plate_id: str = "date_chnm_plate") -> DataFrame:
    """Split ``<date>_<name>_Plate<n>``; the name may hold underscores. Ids of another form give NULL parts."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(quoted(plate_id), PLATE_PATTERN, i), F.lit(""))

    return df.withColumns({"date": part(1), "chnm": part(2), "plate": num.to_number(part(3))})


def direction_table(
    matrix: DataFrame, plate_columns: list[str], channel: str = "steroid", plate_id: str = "date_chnm_plate",
    audit: Audit | None = None,
) -> DataFrame:
    """Channel x plate matrix to rows (plate id, date, chemical, plate, channel, direction), lowest plate per chemical."""
    long = unpivot(matrix, [channel], plate_columns, plate_id, "direction")
    return ranking.lowest_with_ties(plate_parts(long, plate_id), ["chnm"], "plate", plate_id, audit)


def unpack_hits(
    vectors: DataFrame, ids: list[str], channels: list[str], channel: str = "steroid", slots: int = fixed.DOSE_SLOTS
) -> DataFrame:
    """One row per plate, channel and dose slot, at least ``slots`` of them; ``hits`` keeps the packed text."""
    long = unpivot(vectors, ids, channels, channel, "hits")
    return explode_slots(long.withColumn("__v", F.col("hits")), "__v", slots, "dose_level", "hit")


def dose_levels(
    conc: DataFrame, keys: list[str], value: str = "conc", out: str = "dose_level", ties: str | None = None,
) -> DataFrame:
    """Concentration to dose level: its rank among the concentrations of the same keys, ties averaged."""
    return ranking.average_rank(conc, keys, value, out, ties)


def tidy_wells(wells: DataFrame, corrections=None, non_detects=None) -> DataFrame:
    """Split the plate code ``<date>.<x>.<plate>``, parse the date and flag values below the detection limit."""
    code = F.split("apid", r"\.")
    return wells.withColumns({
        "date": txt.day_month_year(F.get(code, F.lit(0)), fixed.DATE_CORRECTIONS if corrections is None else corrections),
        "plate": num.to_number(F.get(code, F.lit(2))),
        "flag": F.when(txt.in_values("ceetox_raw", non_detects or fixed.NON_DETECTS), F.lit(1)).otherwise(F.lit(0)),
    }).drop("apid")


def collapse_replicates(
    wells: DataFrame, keys: list[str], value: str, flag: str, mean_out: str, flag_out: str, scale: int | None = None
) -> DataFrame:
    """Mean of the replicates (NULL if one is missing) and number of flagged ones."""
    return wells.groupBy(*[named(k) for k in keys]).agg(
        num.mean_strict(quoted(value), scale).alias(mean_out),
        F.sum(quoted(flag)).cast("bigint").alias(flag_out),
    )


def fold_change(
    means: DataFrame,
    controls: DataFrame,
    on: list[str],
    mean: str = "uM_bar",
    control: str = "control_bar",
    digits: int = 2,
    out: str = "foldchange",
) -> DataFrame:
    """Treated mean over the control mean of the same keys, fraction rounded to significant digits.

    ``controls`` has one row per key, so the join cannot multiply rows. It is settled as a table first: its true size
    then decides between a broadcast and a shuffle on the few, large control keys.
    """
    joined = join_on(means, cut_lineage(controls), on)
    return joined.withColumn(out, num.signif_frac(num.ratio(mean, control), digits))


def signed_hits(df: DataFrame, fold: str = "foldchange", hit: str = "hit") -> DataFrame:
    """Add ``fc_dir`` (-1, 0, 1) and ``hitd``: a significant dose takes the sign of its change."""
    direction = F.signum(quoted(fold) - 1).cast("int")
    return df.withColumn("fc_dir", direction).withColumn(
        "hitd", F.when(quoted(hit) != 0, F.col("fc_dir")).otherwise(quoted(hit).cast("int"))
    )


def _neighbours(df: DataFrame, keys: list[str], dose: str, hit: str, fields: list[str]) -> DataFrame:
    """One row per key and dose: ``__own`` (hit and fields) and ``__counts``, the consecutive-dose rule. See below.

    The doses of a key are dealt into blocks of ``BLOCK``; a dose at the border of a block is sent to the block beside it
    as well. Rows meet by key and block in one hash exchange, combined in the map tasks, and a block's doses stand side by
    side in one row, so that neighbours are columns. A key may have any number of doses and rows, and no task holds a
    whole key. Of several rows of one key and dose the one with the largest hit, then the largest fields in their order,
    stands as a whole. Only whole numbers from 1 on are doses; rows without one count nothing and keep their key.
    """
    at = f"CASE WHEN {named(dose)} >= 1 AND {named(dose)} = floor({named(dose)}) THEN CAST({named(dose)} AS BIGINT) - 1 END"
    own = "named_struct({})".format(", ".join(f"'{f}', {named(f)}" for f in [hit, *fields]))
    place = f"CAST(coalesce(__at % {BLOCK}, 0) AS INT)"
    cells = (f"array(named_struct('__block', __at DIV {BLOCK}, '__place', {place}, '__cell', __cell),"
             f" CASE WHEN __at % {BLOCK} = 0 AND __at > 0 THEN named_struct('__block', __at DIV {BLOCK} - 1, '__place', {BLOCK}, '__cell', __cell)"
             f" WHEN __at % {BLOCK} = {BLOCK - 1} THEN named_struct('__block', __at DIV {BLOCK} + 1, '__place', -1, '__cell', __cell) END)")
    sent = df.selectExpr(*[named(k) for k in keys], f"{at} AS __at", f"{own} AS __cell").selectExpr(
        *[named(k) for k in keys], f"inline(array_compact({cells}))"
    )
    slots = range(-1, BLOCK + 1)
    met = sent.groupBy(*[named(k) for k in keys], "__block").agg(*[
        F.max(F.when(F.col("__place") == j, F.col("__cell"))).alias(f"__s{j + 1}") for j in slots
    ])

    def mark(j: int) -> str:
        return f"CAST(__s{j + 1}.{named(hit)} AS INT)"

    out = ", ".join(
        f"CASE WHEN __s{j + 1} IS NOT NULL THEN named_struct('__dose', __block * {BLOCK} + {j + 1}, '__own', __s{j + 1}, '__counts',"
        f" __block IS NOT NULL AND __s{j + 1}.{named(hit)} <=> 1 AND ({mark(j - 1)} <=> 1 OR {mark(j + 1)} <=> 1"
        f" OR (__block * {BLOCK} + {j + 1} > 1 AND {mark(j + 1)} IS NULL))) END"
        for j in range(BLOCK)
    )
    return met.selectExpr(*[named(k) for k in keys], f"inline(array_compact(array({out})))")


def consecutive_hits(
    df: DataFrame, keys: list[str], dose: str = "dose_level", hit: str = "hitd",
    fields: tuple[str, ...] = ("conc", "foldchange"),
) -> DataFrame:
    """One row per key and tested dose with ``counts`` telling whether the dose satisfies the consecutive-dose rule.

    A hit counts beside another hit, or where the series ends (no hit value at the next dose) after the first dose.
    """
    met = _neighbours(df, keys, dose, hit, list(fields)).where("__dose IS NOT NULL")
    return met.selectExpr(
        *[named(k) for k in keys], f"CAST(__dose AS INT) AS {named(dose)}",
        *[f"__own.{named(f)} AS {named(f)}" for f in [hit, *fields]], "__counts AS counts",
    )


def lec_mfc(
    df: DataFrame, keys: list[str], dose: str = "dose_level", hit: str = "hitd", conc: str = "conc",
    fold: str = "foldchange",
) -> DataFrame:
    """Lowest effective concentration and maximal fold change over the doses that count, however many there are.

    Keys without a counting dose stay, with LEC = +Infinity and MFC = -Infinity.
    """
    met = _neighbours(df, keys, dose, hit, [fold, conc])
    return met.groupBy(*[named(k) for k in keys]).agg(
        F.expr(f"coalesce(max(CASE WHEN __counts THEN __own.{named(fold)} END), double('-Infinity')) AS MFC"),
        F.expr(f"coalesce(min(CASE WHEN __counts THEN __own.{named(conc)} END), double('Infinity')) AS LEC"),
    )


def tested_range(conc: DataFrame, keys: list[str], value: str = "conc") -> DataFrame:
    """Largest and smallest concentration, the ends of the dose order, in one aggregation; NULL takes no part."""
    return conc.groupBy(*[named(k) for k in keys]).agg(
        F.max(quoted(value)).alias("max_tested_conc"), F.min(quoted(value)).alias("min_tested_conc")
    )


def responders(
    effects: DataFrame, directions: DataFrame, keys: list[str], chem: str, channels: list[str],
    channel: str = "steroid", values: tuple[str, ...] = ("LEC", "MFC", "hits"), direction: str = "direction",
) -> DataFrame:
    """Chemicals that raise at least one of ``channels``: values per channel and the direction of every channel.

    ``effects`` holds rows with direction 1 only; ``directions`` has (chem, channel, direction). Each side is widened
    to one row per key before the join, so it cannot fan out.
    """
    wide = widen(effects.where(quoted(channel).isin(channels)), keys, channel, channels, list(values))
    ways = widen(
        directions.where(quoted(channel).isin(channels)), [chem], channel, channels, [direction]
    )
    raised = None
    for c in channels:
        test = quoted(c) == 1
        raised = test if raised is None else raised | test
    return join_on(wide, ways.where(raised), [chem], "inner")


def attach_distance(df: DataFrame, distances: DataFrame, on: list[str], value: str, digits: int = 2) -> DataFrame:
    """Add a distance score, rounded to fixed decimals, and its text (``<value>_text``)."""
    joined = join_on(df, pick(distances, on + [value]), on)
    return _rounded(joined, [value], digits)


def _rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    texts = df.withColumns({f"{c}_text": num.fixed_decimals(quoted(c), digits) for c in columns})
    return texts.withColumns({c: num.round_decimals(quoted(c), digits) for c in columns})


def attach_matrix(
    df: DataFrame, matrix: DataFrame, code_map: DataFrame, columns: dict[str, str], chem: str = "casn",
    code: str = "code", digits: int = 2,
) -> DataFrame:
    """Add columns of a wide assay matrix through a code table; only the named columns are read.

    ``columns`` maps matrix columns to result names. Values are rounded to fixed decimals and also given as text.
    """
    narrow = matrix.selectExpr(named(code), *[named(c, n) for c, n in columns.items()])
    coded = join_on(narrow, pick(code_map, [code, chem]), [code], "inner").drop(code)
    joined = join_on(df, coded, [chem])
    return _rounded(joined, list(columns.values()), digits)


def clean_names(name: Column) -> Column:
    """Bring prediction names into the spelling of the assay tables."""
    bare = F.regexp_replace(name, '"', "")
    chain = F.when(txt.matches(bare, fixed.NAME_WITHOUT_UNDERSCORE), F.regexp_replace(bare, "_", ""))
    for pattern, full in fixed.NAME_CORRECTIONS:
        chain = chain.when(txt.matches(bare, pattern), F.lit(full))
    return chain.otherwise(bare)


def intake_label(upper: Column, median: Column) -> Column:
    """Upper bound marked ``(u)``, or the median marked ``(m)`` where there is no upper bound."""
    return F.when(upper.isNull(), F.concat(num.number_text(median), F.lit(fixed.MEDIAN_NOTE))).otherwise(
        F.concat(num.number_text(upper), F.lit(fixed.UPPER_NOTE))
    )


def attach_prediction(
    df: DataFrame, predictions: DataFrame, on: dict[str, str], median: str = "seem3", upper: str = "seem3.u95",
    keep: tuple[str, ...] = (), out: str = "seem", digits: int = 2,
) -> DataFrame:
    """Add rounded intake predictions and their label."""
    narrow = pick(predictions, [*on.values(), median, upper, *keep])
    joined = join_on(df, narrow, on)
    rounded = joined.withColumns({c: num.signif_frac(quoted(c), digits) for c in (upper, median)})
    return rounded.withColumn(out, intake_label(quoted(upper), quoted(median)))


def matrix_with_calls(
    values: DataFrame, calls: DataFrame, code_map: DataFrame, columns: dict[str, str] | None = None,
    code: str = "code", chem: str = "casn", value: str = "AC10",
) -> DataFrame:
    """Values and hit calls of some matrix columns as rows (code, chem, column, value, hitcall, hormone)."""
    columns = columns or fixed.MATRIX_COLUMNS
    names = list(columns)
    long = unpivot(pick(values, [code] + names), [code], names, "name", value)
    verdicts = unpivot(pick(calls, [code] + names), [code], names, "name", "hitcall")
    both = join_on(long, verdicts, [code, "name"])
    coded = join_on(both, pick(code_map, [code, chem]), [code])
    hormone = F.lit(None).cast("string")
    for name, channel in columns.items():
        hormone = F.when(F.col("name") == name, F.lit(channel)).otherwise(hormone)
    return coded.withColumn("hormone", hormone)


def active_value(value: Column, call: Column) -> Column:
    """The value of an active substance, NULL otherwise."""
    return F.when(call == 1, value)


def active_label(value: Column, call: Column, digits: int = 3) -> Column:
    """Back-transformed value as text, marked where the substance is not active; NULL if there is no clear call."""
    shown = num.number_text(F.round(F.pow(F.lit(10.0), value), digits))
    return F.when((call == 0) & shown.isNotNull(), F.concat(shown, F.lit(" " + fixed.INACTIVE_NOTE))).when(
        call == 1, shown
    )


def cut_label(value: Column, cuts=None) -> Column:
    """Number as text with the note of the first cut it reaches."""
    shown = num.number_text(value)
    chain = None
    for bound, note in cuts or fixed.BIOACTIVITY_CUTS:
        text = F.concat(shown, F.lit(" " + note))
        chain = F.when(value >= bound, text) if chain is None else chain.when(value >= bound, text)
    return chain.otherwise(shown)


def bioactivity(
    areas: DataFrame, key: str, agonist: str, antagonist: str, out: str = "AUC.Bioactivity"
) -> DataFrame:
    """Largest of both areas over all rows of a key; NULL if one is missing."""
    return areas.groupBy(quoted(key)).agg(
        num.max_strict(num.row_max_strict(quoted(agonist), quoted(antagonist))).alias(out)
    )


def label_areas(
    areas: DataFrame, key: str, agonist: str, antagonist: str, out: str = "AUC.Bioactivity"
) -> DataFrame:
    """Per row: both areas and the key's largest area, each as labelled text."""
    top = bioactivity(areas, key, agonist, antagonist, out)
    joined = join_on(pick(areas, [key, agonist, antagonist]), top, [key])
    return joined.select(quoted(key), *[cut_label(quoted(c)).alias(c) for c in (agonist, antagonist, out)])
