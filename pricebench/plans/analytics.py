"""The analytics views: A5–A19, F2–F7, J6, J9, L1, L4, W4.

``lines`` is the whole dataset, ``grouped`` the usable lines with their part,
``clusters`` and ``variants`` the benchmark tables built from ``grouped``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.functions import rules
from pricebench.functions.numeric import exact_sum, round_half_up, to_fixed
from pricebench.functions.parts import cv_band, model_label, money, normal_part_number
from pricebench.operators.clusters import in_cluster_order, variant_list
from pricebench.operators.quantiles import grouped_quantiles

_SUPPLIER_PART = "Supplier Part"


def _supplier_parts(lines: DataFrame, exclude_review: bool = False) -> DataFrame:
    """Unlike the benchmark itself, most views keep lines under review."""
    parts = lines.where(F.col("ltype") == _SUPPLIER_PART)
    return parts.where(~F.col("review")) if exclude_review else parts


def _percent(x: Column) -> Column:
    return F.concat(to_fixed(x, 0).cast("long").cast("string"), F.lit("%"))


# ---- dataset overview -------------------------------------------------------------------


def kpis(lines: DataFrame, clusters: DataFrame, exclude_review: bool = False) -> DataFrame:
    """A5: one row.  ``usable`` counts lines under review as well."""
    part = F.col("ltype") == _SUPPLIER_PART
    if exclude_review:
        part = part & ~F.col("review")
    sizes = clusters.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("n") > 1).alias("r"))
    return lines.agg(
        F.count_distinct(F.nullif(F.col("bill_no"), F.lit(""))).alias("invoices"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(part).alias("usable"),
        F.count_distinct(F.when(part, F.col("make"))).alias("makes"),
        F.count_if(F.col("review")).alias("review"),
    ).withColumns({"clusters": sizes.select("c").scalar(), "ready": sizes.select("r").scalar()})


def bills(lines: DataFrame) -> DataFrame:
    """Bills with their lines and total, most lines first."""
    head = F.struct("supplier", F.coalesce(F.nullif(F.col("bill_date"), F.lit("")), F.lit("—")).alias("date"), "make", "doc_type")
    rows = lines.groupBy(F.coalesce(F.nullif(F.col("bill_no"), F.lit("")), F.lit("(no number)")).alias("bill")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum(F.col("total")).alias("t"), F.min("seq").alias("first_seq"),
        F.min_by(head, "seq").alias("h"),
    )
    return rows.select(
        "bill", F.col("h.supplier").alias("supplier"), F.col("h.date").alias("date"), F.col("h.make").alias("make"),
        F.col("h.doc_type").alias("doc"), "n", to_fixed(F.col("t"), 2).alias("total"),
    ).orderBy(F.col("n").desc(), "bill")


def line_types(lines: DataFrame) -> DataFrame:
    """Count and share of each line type, in report order."""
    order = F.array(*[F.lit(t) for t in rules.LINE_TYPES])
    counts = lines.groupBy("ltype").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("ltype", "n", _percent(F.col("n") / total * 100).alias("share")).orderBy(
        F.array_position(order, F.col("ltype"))
    )


def usable_by_category(lines: DataFrame, exclude_review: bool = False) -> DataFrame:
    """A8."""
    return (
        _supplier_parts(lines, exclude_review).groupBy("cat")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("npn").alias("part_numbers"))
        .orderBy(F.col("n").desc(), "cat")
    )


def size_bands(clusters: DataFrame) -> DataFrame:
    """A9."""
    band = F.when(F.col("n") == 1, "1 quote").when(F.col("n") == 2, "2 quotes").when(F.col("n") == 3, "3 quotes")
    return clusters.groupBy(band.otherwise("4+ quotes").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size")


def by_make(lines: DataFrame, clusters: DataFrame, exclude_review: bool = False) -> DataFrame:
    """A10."""
    parts = _supplier_parts(lines, exclude_review).groupBy("make").agg(F.count(F.lit(1)).alias("parts"))
    groups = clusters.groupBy("make").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("n") > 1).alias("ready")
    )
    return (
        parts.join(groups, "make", "left")
        .select("make", "parts", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("ready", F.lit(0)).alias("ready"))
        .orderBy(F.col("parts").desc(), "make")
    )


def review_queue(lines: DataFrame) -> DataFrame:
    """Bills held back, with the reason."""
    return (
        lines.where("review").groupBy("bill_no")
        .agg(F.min_by(F.struct("supplier", "review_reason"), "seq").alias("h"), F.count(F.lit(1)).alias("n"))
        .select("bill_no", "h.supplier", F.col("h.review_reason").alias("reason"), "n")
    )


def coverage(lines: DataFrame, makes=rules.COVERAGE_MAKES, exclude_review: bool = False) -> DataFrame:
    """Usable lines of each listed make; a make without any is a gap."""
    listed = lines.sparkSession.createDataFrame(list(enumerate(makes)), "position int, make string")
    counts = (
        _supplier_parts(lines, exclude_review).where(F.col("make").isin(*makes))
        .groupBy("make").agg(F.count(F.lit(1)).alias("parts"))
    )
    return listed.join(counts, "make", "left").select(
        "position", "make", F.coalesce("parts", F.lit(0)).alias("parts"), F.col("parts").isNull().alias("gap")
    ).orderBy("position")


def coverage_summary(lines: DataFrame, clusters: DataFrame, makes=rules.COVERAGE_MAKES, exclude_review: bool = False) -> DataFrame:
    """A19 in one row."""
    ready = clusters.where("n > 1").agg(F.count(F.lit(1))).scalar()
    return _supplier_parts(lines, exclude_review).agg(
        F.count_distinct(F.when(F.col("make").isin(*makes), F.col("make"))).alias("makes_hit"),
        F.count_distinct("cat").alias("categories"),
    ).withColumns({"makes_listed": F.lit(len(makes)), "ready": ready})


def distinct_options(lines: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """The values a filter offers."""
    rows = lines if where is None else lines.where(where)
    return rows.select(column).where((F.col(column) != "") & (F.col(column) != "—")).distinct().orderBy(column)


# ---- filters ----------------------------------------------------------------------------


def ledger(lines: DataFrame, make: str | None = None, ltype: str | None = None, search: str = "") -> DataFrame:
    """F2."""
    if make is not None:
        lines = lines.where(F.col("make") == make)
    if ltype is not None:
        lines = lines.where(F.col("ltype") == ltype)
    if search:
        lines = lines.where(F.contains(F.lower(F.concat("part_name", "part_number", "supplier")), F.lit(search.lower())))
    return lines


def bill_context(lines: DataFrame) -> DataFrame:
    """Each line with the size and total of its bill; a line without a bill number stands alone."""
    totals = lines.where(F.col("bill_no") != "").groupBy("bill_no").agg(
        F.count(F.lit(1)).alias("_n"), exact_sum(F.col("total")).alias("_t")
    )
    return lines.join(totals, "bill_no", "left").select(
        *lines.columns,
        F.coalesce("_n", F.lit(1)).alias("bill_lines"),
        to_fixed(F.coalesce("_t", "total"), 2).alias("bill_total"),
    )


def line_details(lines: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """J5 + J6: every line with its bill and the benchmark it feeds, if any."""
    bench = members.select("seq", "cluster_id").join(
        clusters.select("cluster_id", F.col("label").alias("bench_label"), F.col("n").alias("bench_n"), F.col("med").alias("bench_med")),
        "cluster_id",
    )
    return bill_context(lines).join(bench, "seq", "left")


def lookup(
    clusters: DataFrame, variants: DataFrame, make: str | None = None, models: list[str] | None = None,
    name: str = "", part_number: str = "", search: str = "",
) -> DataFrame:
    """Parts that pass every given filter, most quotes first.

    A search term holds no blank, so finding it in the joined text of a part is
    the same as finding it in one of the pieces; the pieces never get joined.
    """
    value, kind = F.col("value"), F.col("kind")
    terms = search.lower().split()
    wanted_pn = clusters.sparkSession.range(1).select(normal_part_number(F.lit(part_number)).alias("p")).scalar()
    searchable = kind.isin("name", "pn", "raw_pn", "model")
    tests = {
        "_model": (kind == "model") & value.isin(*(models or [""])),
        "_name": (kind == "name") & F.contains(F.lower(value), F.lit(name.lower())),
        "_pn": ((kind == "pn") & F.contains(value, wanted_pn))
        | ((kind == "raw_pn") & F.contains(normal_part_number(value), wanted_pn)),
    }
    for i, term in enumerate(terms):
        tests[f"_term{i}"] = searchable & F.contains(F.lower(value), F.lit(term))
    used = [k for k, on in (("_model", models), ("_name", name), ("_pn", part_number)) if on]
    used += [f"_term{i}" for i in range(len(terms))]
    found = clusters if make is None else clusters.where(F.col("make") == make)
    if used:
        hits = variants.groupBy("cluster_id").agg(*[F.bool_or(tests[k]).alias(k) for k in used])
        found = found.join(hits, "cluster_id")
        own = F.lower(F.concat_ws(" ", "label", "make", "model", "cat", "grade"))
        for k in used:
            ok = F.col(k)
            if k == "_name":
                ok = ok | F.contains(F.lower("label"), F.lit(name.lower()))
            if k == "_pn":
                ok = ok | (wanted_pn == "")
            if k.startswith("_term"):
                ok = ok | F.contains(own, F.lit(terms[int(k[5:])]))
            found = found.where(ok)
    return found.select(*clusters.columns).orderBy(F.col("n").desc(), F.col("med").desc(), "cluster_order")


def natural_key(value: Column) -> Column:
    """Case-blind text key in which runs of digits sort by their number, however long they are."""
    pieces = F.regexp_extract_all(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit("([0-9]+|[^0-9]+)"), 1)

    def by_size(run: Column) -> Column:
        bare = F.ltrim(run, F.lit("0"))
        return F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), bare)  # a longer number is a greater one

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), by_size(p)).otherwise(p)), "")


def order_by_any(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """L1: numbers, money signs ignored, before text; descending reverses everything."""
    number, key = money(F.col(column)), natural_key(F.col(column))
    if descending:
        return df.orderBy(number.isNull().desc(), number.desc(), key.desc())
    return df.orderBy(number.isNull(), number, key)


# ---- the eight views --------------------------------------------------------------------


def benchmark_view(clusters: DataFrame, least_quotes: int = 2, fallback: int | None = 25) -> DataFrame:
    """Median benchmark, F4/L4: parts with two or more quotes, or ``fallback`` (None: all) single ones if there are none.

    ``least_quotes=1`` shows every part.
    """
    ready = clusters.where(F.col("n") >= least_quotes)
    none_ready = ready.agg(F.count(F.lit(1)) == 0).scalar()
    few = clusters if fallback is None else in_cluster_order(clusters).limit(fallback)
    return in_cluster_order(ready.unionByName(few.where(none_ready)))


def top_benchmarks(clusters: DataFrame, count: int = 10) -> DataFrame:
    """L4."""
    return in_cluster_order(clusters.where("n > 1")).limit(count)


def inflation(grouped: DataFrame, clusters: DataFrame, percent: float = 30.0) -> DataFrame:
    """quotes at least ``percent`` above their median; compared unrounded."""
    bench = clusters.where("n > 1").select(
        "cluster_id", "med", F.col("n").alias("quotes"),
        F.col("make").alias("part_make"), model_label(F.col("model"), F.col("n_models")).alias("part_model"),
    )
    over = F.when(F.col("med") == 0, F.lit(0.0)).otherwise((F.col("unit") - F.col("med")) / F.nullif(F.col("med"), F.lit(0.0)) * 100)
    return (
        grouped.select("id", "cluster_id", "part_name", "supplier", "bill_no", "bill_date", "unit")
        .join(bench, "cluster_id")
        .withColumn("over_raw", over)
        .where(F.col("over_raw") >= F.lit(float(percent)))
        .select(
            "id", "part_name", F.col("part_make").alias("make"), F.col("part_model").alias("model"), "supplier",
            "bill_no", "bill_date", F.col("unit").alias("quoted"), "med", "quotes",
            F.concat(F.lit("+"), _percent(F.col("over_raw"))).alias("over"),
        )
    )


def confidence(clusters: DataFrame, as_of: dt.date) -> DataFrame:
    """Depth, supplier diversity and recency of the newest quote as of a given day."""
    depth = F.least(F.lit(1.0), (F.col("n") - 1) / 4)
    diversity = F.least(F.lit(1.0), (F.col("n_suppliers") - 1) / 3)
    age = F.date_diff(F.lit(as_of), F.col("last_date")) / F.lit(365.0 * 3)
    recency = F.coalesce(F.lit(1.0) - F.least(F.lit(1.0), age), F.lit(0.0))
    score = round_half_up((F.lit(0.4) * depth + F.lit(0.35) * diversity + F.lit(0.25) * recency) * 100)
    return (
        clusters.where("n > 1")
        .select(
            "cluster_id", "cluster_order", "label", "make", model_label(F.col("model"), F.col("n_models")).alias("model"),
            "n", F.col("n_suppliers").alias("suppliers"), score.alias("score"), "cv", cv_band(F.col("cv")).alias("spread"),
            F.lit(as_of).alias("as_of"),
        )
        .withColumn("band", F.when(F.col("score") >= 60, "High").when(F.col("score") >= 30, "Medium").otherwise("Low"))
        .orderBy(F.col("score").desc(), F.col("n").desc(), "cluster_order")
    )


def supplier_dispersion(grouped: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cheapest and dearest quote of each part, the first one on ties."""
    quote = F.struct("supplier", "unit", "bill_no")
    ends = grouped.groupBy("cluster_id").agg(
        F.min_by(quote, F.struct("unit", "member_rank")).alias("lo"),
        F.min_by(quote, F.struct(-F.col("unit"), F.col("member_rank"))).alias("hi"),
    )
    return (
        clusters.where((F.col("n") > 1) & (F.col("spread") > 0)).join(ends, "cluster_id")
        .select(
            "cluster_id", "cluster_order", "label", "make", model_label(F.col("model"), F.col("n_models")).alias("model"),
            "spread", "q1", "q3", "iqr", "sd", "cv", cv_band(F.col("cv")).alias("cv_band"),
            F.when(F.col("med") != 0, _percent(F.col("spread") / F.col("med") * 100)).otherwise("—").alias("of_median"),
            F.col("lo.supplier").alias("cheapest"), F.col("lo.unit").alias("cheapest_unit"), F.col("lo.bill_no").alias("cheapest_bill"),
            F.col("hi.supplier").alias("dearest"), F.col("hi.unit").alias("dearest_unit"), F.col("hi.bill_no").alias("dearest_bill"),
            F.col("grade_mixed").alias("grades_differ"), "reliable",
        )
        .orderBy(F.col("spread").desc(), "cluster_order")
    )


def agreement(clusters: DataFrame, variants: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Do independent suppliers agree within the tolerance?"""
    ratio = F.col("spread") / F.nullif(F.col("med"), F.lit(0.0))
    several = clusters.where("n_suppliers > 1")
    names = variant_list(
        variants.where(F.col("kind") == "supplier").join(several.select("cluster_id"), "cluster_id", "left_semi"),
        "supplier", "suppliers",
    )
    verdict = F.when(ratio <= tolerance, "Agree (≤10%)" if tolerance == 0.1 else f"Agree (≤{tolerance:.0%})").otherwise("Diverge")
    return (
        several.join(names, "cluster_id")
        .select(
            "cluster_id", "label", "make", model_label(F.col("model"), F.col("n_models")).alias("model"),
            F.array_join("suppliers", ", ").alias("suppliers"), "med", "spread",
            _percent(F.coalesce(ratio, F.lit(0.0)) * 100).alias("tolerance"), verdict.alias("verdict"),
            "n", "cluster_order",
        )
        .orderBy("verdict", F.col("n").desc(), "cluster_order")
        .drop("n", "cluster_order")
    )


def list_and_net(lines: DataFrame) -> DataFrame:
    """List against net price inside each estimate."""
    estimates = lines.where(
        F.contains(F.lower("doc_type"), F.lit("estimate")) & (F.col("unit") != 0) & (F.col("total") != 0)
        & (F.col("unit") != F.col("total"))
    )
    sums = estimates.groupBy(F.col("bill_no").alias("bill")).agg(
        F.min_by("supplier", "seq").alias("supplier"), exact_sum(F.col("unit")).alias("_l"), exact_sum(F.col("total")).alias("_n"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select(
        "bill", "supplier", "n", to_fixed(F.col("_l"), 0).alias("list"), to_fixed(F.col("_n"), 0).alias("net"),
        F.when(F.col("_l") != 0, _percent((F.col("_l") - F.col("_n")) / F.col("_l") * 100)).alias("discount"),
    )


def same_part_number(lines: DataFrame) -> DataFrame:
    """Part numbers on more than one bill, over all line types."""
    return (
        lines.where(F.col("npn") != "").groupBy("npn")
        .agg(
            F.min_by(F.struct("part_name", "part_number"), "seq").alias("h"),
            F.count(F.lit(1)).alias("n"), F.count_distinct("bill_no").alias("n_bills"),
            (F.min("unit") == F.max("unit")).alias("identical_price"),
        )
        .where("n_bills > 1")
        .select("npn", "h.part_name", "h.part_number", "n", "n_bills", "identical_price")
    )


def same_part_number_quotes(lines: DataFrame) -> DataFrame:
    """The lines behind :func:`same_part_number`."""
    keys = same_part_number(lines).select("npn", "n_bills", "identical_price")
    return lines.join(keys, "npn").select("npn", "n_bills", "identical_price", "supplier", "unit", "bill_no", "bill_date", "seq")


#: Categories of a trend report by default; an argument, None means all.
TREND_CATEGORIES = 6


def _dated(lines: DataFrame, exclude_review: bool) -> DataFrame:
    return _supplier_parts(lines, exclude_review).where(F.col("bill_dt").isNotNull())


def trend(lines: DataFrame, exclude_review: bool = False, categories: int | None = TREND_CATEGORIES) -> DataFrame:
    """The ``categories`` with most dated lines (three at least)."""
    dated = _dated(lines, exclude_review)
    stats = dated.groupBy("cat").agg(
        F.count(F.lit(1)).alias("n"), F.min("unit").alias("min_unit"), F.max("unit").alias("max_unit"),
        F.min("seq").alias("first_seq"),
    )
    top = stats.where("n >= 3").orderBy(F.col("n").desc(), "first_seq")
    if categories is not None:
        top = top.limit(categories)
    medians = grouped_quantiles(dated.join(top.select("cat"), "cat", "left_semi"), ["cat"], "unit", {"med": 0.5})
    return top.join(medians, "cat").select("cat", "n", "min_unit", "max_unit", to_fixed(F.col("med"), 0).alias("med"), "first_seq").orderBy(
        F.col("n").desc(), "first_seq"
    )


def trend_points(lines: DataFrame, exclude_review: bool = False, categories: int | None = TREND_CATEGORIES) -> DataFrame:
    """Where each line of a trend category sits: date on 2..98, price on 90..10."""
    dated = _dated(lines, exclude_review)
    span = dated.agg(F.min("bill_dt").alias("a"), F.max("bill_dt").alias("b"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    top = trend(lines, exclude_review, categories).select("cat", "min_unit", "max_unit")
    days = F.coalesce(F.nullif(F.date_diff(last, first), F.lit(0)), F.lit(1))
    price_range = F.coalesce(F.nullif(F.col("max_unit") - F.col("min_unit"), F.lit(0.0)), F.lit(1.0))
    return dated.join(top, "cat").select(
        "id", "cat", "bill_dt", "unit",
        (F.date_diff(F.col("bill_dt"), first) / days * 96 + 2).alias("x"),
        (F.lit(90.0) - (F.col("unit") - F.col("min_unit")) / price_range * 80).alias("y"),
    )


#: Parts of the normalisation report by default; an argument, None means all.
NORMALISED_ROWS = 30


def normalised_values(clusters: DataFrame, variants: DataFrame) -> DataFrame:
    """A18 in long form: one row per part that unified several names or numbers, and name or number, in member order."""
    unified = clusters.where("n_names > 1 or n_pns > 1").select("cluster_id", "cluster_order", F.col("n").alias("quotes"), "label", "make")
    return unified.join(variants.where(F.col("kind").isin("name", "pn")), "cluster_id").select(
        "cluster_id", "cluster_order", "quotes", "label", "make", "kind", "value", "first_rank", "n")


def normalised(clusters: DataFrame, variants: DataFrame, rows: int | None = NORMALISED_ROWS) -> DataFrame:
    """The first parts that unified several names or part numbers, each with its lists in a cell."""
    top = in_cluster_order(clusters.where("n_names > 1 or n_pns > 1"))
    if rows is not None:
        top = top.limit(rows)
    theirs = variants.join(top.select("cluster_id"), "cluster_id", "left_semi")
    return in_cluster_order(
        top.join(variant_list(theirs, "name", "names"), "cluster_id").join(variant_list(theirs, "pn", "pns"), "cluster_id", "left")
    ).select(
        "label", "make", model_label(F.col("model"), F.col("n_models")).alias("model"), "n_names", "n_pns",
        F.array_join("names", "  |  ").alias("names"), F.coalesce(F.array_join("pns", "  |  "), F.lit("")).alias("pns"), "bridged",
    )
