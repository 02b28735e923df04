"""Name features and pair scores: E12–E14 and E16–E20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.functions import rules
from pricebench.functions.parts import let, text


def words(name: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    spaced = F.trim(F.regexp_replace(F.lower(text(name)), "[^a-z0-9]+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def normal_name_of(w: Column, stopwords=rules.STOPWORDS) -> Column:
    stop = F.array(*[F.lit(s) for s in stopwords])
    return F.array_join(F.filter(w, lambda x: ~F.array_contains(stop, x)), " ")


def normal_name(name: Column, stopwords=rules.STOPWORDS) -> Column:
    """E12."""
    return normal_name_of(words(name), stopwords)


def tokens(normal: Column) -> Column:
    """E13, on a name that E12 has been through."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: w != ""))


def position_of(w: Column) -> Column:
    def ends(found: Column) -> Column:
        def axis(pair) -> Column:
            (a, a_words), (b, b_words) = pair
            has_a = F.arrays_overlap(found, F.array(*[F.lit(x) for x in a_words]))
            has_b = F.arrays_overlap(found, F.array(*[F.lit(x) for x in b_words]))
            return F.when(has_a & ~has_b, a).when(has_b & ~has_a, b).otherwise("")

        return F.struct(*[axis(pair).alias(name_) for name_, pair in rules.POSITION_AXES.items()])

    return let(w, ends)


def position(name: Column) -> Column:
    """One end per axis; an axis on which both ends are named is blank."""
    return position_of(words(name))


def with_name_features(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """Add ``nn`` (normal name), ``tk`` (tokens) and ``pos``, each once per row."""
    return (
        df.withColumn("_words", words(F.col(name)))
        .withColumns({f"{prefix}nn": normal_name_of(F.col("_words")), f"{prefix}pos": position_of(F.col("_words"))})
        .withColumn(f"{prefix}tk", tokens(F.col(f"{prefix}nn")))
        .drop("_words")
    )


def jaccard(a: Column, b: Column) -> Column:
    """E16, on distinct token arrays."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common / F.greatest(union, F.lit(1)))


def edit_similarity(a: Column, b: Column) -> Column:
    """E17, on normal names."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest
    )


def similarity(a_nn: Column, a_tk: Column, b_nn: Column, b_tk: Column, token_weight) -> Column:
    """E18.  ``token_weight`` is a number or a column."""
    w = token_weight if isinstance(token_weight, Column) else F.lit(float(token_weight))
    return w * jaccard(a_tk, b_tk) + (F.lit(1.0) - w) * edit_similarity(a_nn, b_nn)


def grade_conflict(a: Column, b: Column) -> Column:
    """Only two known, different grades conflict."""
    return (a != "Unknown") & (b != "Unknown") & (a != "") & (b != "") & (a != b)


def position_conflict(a: Column, b: Column, separate_sides: bool = False) -> Column:
    """A blank axis never conflicts; sides count only when asked for."""
    axes = ["end", "vert", "depth"] + (["side"] if separate_sides else [])
    clash = F.lit(False)
    for axis in axes:
        x, y = a.getField(axis), b.getField(axis)
        clash = clash | ((x != "") & (y != "") & (x != y))
    return clash
