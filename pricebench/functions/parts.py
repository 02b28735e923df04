"""Enrichment expressions E1–E11 and E15, E21, E23, E24, E26."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, functions as F

from pricebench.functions import rules
from pricebench.functions.numeric import WHITE_SPACE, strip


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def non_blank(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    A plain reference would be copied into every place ``body`` uses it, and the
    copies multiply when the optimizer moves a filter below the projection.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_match(cases: list[tuple[Column, str]], otherwise: Column) -> Column:
    expr = None
    for condition, value in cases:
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return otherwise if expr is None else expr.otherwise(otherwise)


def _tagged(name: Column, texts: tuple[str, ...], pattern: str) -> Column:
    """Whether ``pattern`` is found in ``name``; it runs only on names that hold one of ``texts``, which most do not."""
    return functools.reduce(operator.or_, [F.contains(name, F.lit(t)) for t in texts]) & name.rlike(pattern)


def normal_part_number(pn: Column) -> Column:
    """E1.  The order matters; genuine trailing 999s go as well."""
    # The patterns run only where their mark occurs; most numbers carry none.
    def bare(p: Column) -> Column:
        return F.when(F.contains(p, F.lit("(")), F.regexp_replace(p, r"\(.*?\)", "")).otherwise(p)

    p = let(strip(F.upper(text(pn))), bare)
    p = let(
        F.substring_index(p, "/", 1),
        lambda q: F.when(F.endswith(q, F.lit("999")), F.rtrim(q, F.lit("9"))).otherwise(q),
    )
    return F.translate(p, WHITE_SPACE + "-.", "")


_LETTERS_IN_A_SET = 5


def _texts_in(keys: list[str]) -> str:
    """A pattern that finds, at each place of a text, the first of ``keys`` that begins there.

    Keys are filed under their first letter and letters in sets of a few, so that a place is compared with few of them.
    """
    filed: dict[str, list[str]] = {}
    for k in keys:
        filed.setdefault(k[0], []).append(k[1:])
    quoted = lambda s: re.sub(r"([^A-Za-z0-9 ])", r"\\\1", s)
    letters, size = sorted(filed), _LETTERS_IN_A_SET
    sets = [letters[i:i + size] for i in range(0, len(letters), size)]
    in_set = lambda s: "|".join(f"{quoted(c)}(?:{'|'.join(map(quoted, filed[c]))})" for c in s)
    return "(?=(" + "|".join(f"(?=[{''.join(map(quoted, s))}])(?:{in_set(s)})" for s in sets) + "))"


def category(name: Column, table=rules.CATEGORY_RULES) -> Column:
    """The first rule any of whose texts occurs in the name.

    The name is read once for all rules; of the texts that begin at one place the one of the earliest rule is found.
    """
    padded = F.concat(F.lit(" "), F.lower(text(name)), F.lit(" "))
    # A rule with an empty text takes every name that no rule before it takes.
    always = next((i for i, (_, keys) in enumerate(table) if "" in keys), len(table))
    rule_of: dict[str, int] = {}
    for i, (_, keys) in enumerate(table[:always]):
        for k in keys:
            rule_of.setdefault(k, i)
    otherwise = F.lit(table[always][0] if always < len(table) else "Other")
    if not rule_of:
        return otherwise
    places = F.create_map(*[F.lit(x) for kv in rule_of.items() for x in kv])
    names = F.array(*[F.lit(cat) for cat, _ in table])

    def decide(found: Column) -> Column:
        first = F.array_min(F.transform(found, lambda k: F.try_element_at(places, k)))
        return F.when(F.size(found) == 0, otherwise).otherwise(F.get(names, first))

    return let(F.regexp_extract_all(padded, F.lit(_texts_in(list(rule_of))), F.lit(1)), decide)


def _make_key(make: str) -> str:
    return "".join(ch for ch in make.lower() if ch.isascii() and ch.isalnum())


def canonical_make(make: Column, makes=rules.COVERAGE_MAKES, aliases=None) -> Column:
    """Fold spellings of a known make; an unlisted make stays as written."""
    lookup = {_make_key(m): m for m in makes} | dict(rules.MAKE_ALIASES if aliases is None else aliases)
    pairs = F.create_map(*[F.lit(x) for kv in lookup.items() for x in kv])

    def fold(raw: Column) -> Column:
        key = F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "")
        return F.when((raw == "") | (F.lower(raw) == "unknown"), "Unknown").otherwise(
            F.coalesce(F.try_element_at(pairs, key), raw)
        )

    return let(strip(text(make)), fold)


def make_of(npn: Column, bill_make: Column, prefixes=rules.MAKE_PREFIXES) -> Column:
    """The make on the bill, else the one the part number starts with."""
    given = text(bill_make)
    guessed = let(npn, lambda pn: first_match([(pn.rlike(p), m) for p, m in prefixes], F.lit("Unknown")))
    return F.when((given != "") & (given != "Unknown"), canonical_make(given)).otherwise(guessed)


def line_type(doc_type: Column, cat: Column) -> Column:
    """E5."""
    doc = F.lower(text(doc_type))
    return (
        F.when(F.contains(doc, F.lit("estimate")), "Repair Estimate")
        .when(cat == "Consumable/Fastener", "Consumable / Fastener")
        .when(F.contains(doc, F.lit("labour")), "Labour")
        .otherwise("Supplier Part")
    )


def grade_of(name: Column, provided: Column) -> Column:
    """A valid supplied grade wins over tags in the name."""
    given = strip(text(provided))
    padded = F.concat(F.lit(" "), F.lower(text(name)), F.lit(" "))
    tagged = let(padded, lambda n: first_match([(_tagged(n, rules.GRADE_TEXTS[g], p), g) for g, p in rules.GRADE_TAGS], F.lit("Unknown")))
    return F.when(given.isin(*rules.GRADES), given).otherwise(tagged)


def basis_of(name: Column, provided: Column) -> Column:
    """E7."""
    given = F.lower(strip(text(provided)))
    padded = F.concat(F.lit(" "), F.lower(text(name)), F.lit(" "))
    tagged = let(
        padded, lambda n: F.when(_tagged(n, rules.SET_TEXTS, rules.SET_TAG), "set")
        .when(_tagged(n, rules.PAIR_TEXTS, rules.PAIR_TAG), "pair").otherwise("each")
    )
    return F.when(given.isin(*rules.UNIT_BASES), given).otherwise(tagged)


def gst_of(value: Column) -> Column:
    """E8."""
    v = F.lower(text(value))
    return F.when(v.isin("incl", "excl"), v).otherwise("unknown")


def _rolled_date(y: Column, m: Column, d: Column) -> Column:
    """Calendar overflow rolls on: 31/02 is 3 March (2 March in a leap year)."""
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)


def bill_date_of(printed: Column) -> Column:
    """ISO anywhere in the text, else day/month/year anywhere, else NULL."""
    def number(p: Column, i: int) -> Column:
        return p[i].cast("int")

    def from_iso(found: Column) -> Column:
        return F.when(found != "", let(F.split(found, "-"), lambda p: _rolled_date(number(p, 0), number(p, 1), number(p, 2))))

    def from_dmy(found: Column) -> Column:
        def of(p: Column) -> Column:
            year = number(p, 2)
            return _rolled_date(F.when(year < 100, year + 2000).otherwise(year), number(p, 1), number(p, 0))

        return F.when(found != "", let(F.split(found, "/"), of))

    def read(t: Column) -> Column:
        iso = F.when(F.contains(t, F.lit("-")), F.regexp_extract(t, "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0))
        dmy = F.regexp_extract(t, "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", 0)
        return F.coalesce(let(iso, from_iso), let(dmy, from_dmy))

    return let(text(printed), read)


def model_key(model: Column) -> Column:
    """E15."""
    bare = F.lower(strip(F.regexp_replace(text(model), r"\(.*?\)", "")))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("—"))


def bill_key(supplier: Column, bill_no: Column) -> Column:
    """What makes two bills the same bill."""
    return F.concat(F.lower(strip(text(supplier))), F.lit("|"), F.lower(strip(text(bill_no))))


def cv_band(cv: Column) -> Column:
    """E23."""
    return F.when(cv.isNull(), "—").when(cv < 10, "tight").when(cv < 25, "moderate").otherwise("wide")


def model_label(model: Column, n_models: Column) -> Column:
    """The first model, with how many others the part spans."""
    return (
        F.when(text(model).isin("", "—"), "—")
        .when(n_models > 1, F.concat(model, F.lit(" +"), (n_models - 1).cast("string")))
        .otherwise(model)
    )


def money(value: Column) -> Column:
    """The leading number of a printed amount, else NULL."""
    bare = F.regexp_replace(F.translate(text(value), WHITE_SPACE + ",S$", ""), "^[+≈~]", "")
    return F.nullif(F.regexp_extract(bare, r"^-?[0-9]*\.?[0-9]+", 0), F.lit("")).try_cast("double")
