"""What a chassis number says about a vehicle: check digit, make, and a key that separates models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pricebench.functions.numeric import strip
from pricebench.functions.parts import first_match, let, make_of, text

VIN_LENGTH = 17

# What letters count in the check sum of a vehicle number (I, O and Q don't occur), the
# weight of each place, and the sign of remainder 10.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_VALUES = "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_TEN = "X"

# First characters of vehicle numbers and the make they stand for.
MAKER_CODES = {
    "JT": "Toyota", "MR0": "Toyota",
    "JHM": "Honda", "MRH": "Honda",
    "WDB": "Mercedes-Benz", "WDD": "Mercedes-Benz", "W1K": "Mercedes-Benz",
    "WBA": "BMW", "WBS": "BMW",
    "WAU": "Audi",
    "WVW": "Volkswagen",
    "KMH": "Hyundai",
    "KNA": "Kia",
    "JM0": "Mazda", "JM7": "Mazda",
    "JN1": "Nissan", "SJN": "Nissan",
    "JMB": "Mitsubishi",
    "JF1": "Subaru",
}


def vin(chassis: Column) -> Column:
    """A chassis number as 17 letters and digits, else NULL: registration plates and short numbers are no vehicle numbers."""
    bare = F.regexp_replace(F.upper(strip(text(chassis))), "[\\s.-]", "")
    return let(bare, lambda v: F.when(v.rlike(f"^[{VIN_LETTERS}0-9]{{{VIN_LENGTH}}}$"), v))


def check_digit(number: Column) -> Column:
    """The check character that belongs to a vehicle number (NULL stays NULL)."""
    def total(digits: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(VIN_WEIGHTS) if w])

    # The place of the check character itself has no weight.
    remainder = let(F.translate(number, VIN_LETTERS, VIN_VALUES), total) % 11
    return F.when(remainder == 10, VIN_TEN).otherwise(remainder.cast("string"))


def check_ok(number: Column) -> Column:
    """Whether the ninth character is the check character; makers outside North America and China needn't keep to it, so this is a mark, not a filter."""
    return F.substring(number, 9, 1) == check_digit(number)


def make_of_vin(number: Column, codes: dict[str, str] | None = None) -> Column:
    """The make of the longest maker code that a vehicle number starts with, else NULL."""
    codes = MAKER_CODES if codes is None else codes
    if not codes:
        return F.lit(None).cast("string")
    lookup = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    lengths = sorted({len(c) for c in codes}, reverse=True)
    return F.coalesce(*[F.try_element_at(lookup, F.substring(number, 1, n)) for n in lengths])


def make_of_line(npn: Column, bill_make: Column, chassis: Column, codes: dict[str, str] | None = None) -> Column:
    """The make on the bill, else the vehicle number's, else the one the part number starts with, else Unknown."""
    printed = make_of(F.lit(""), bill_make)
    return first_match([(printed != "Unknown", printed)], F.coalesce(make_of_vin(vin(chassis), codes), make_of(npn, F.lit(""))))


def chassis_model_key(chassis: Column, otherwise: Column) -> Column:
    """The first eight characters of a vehicle number in place of the model's name.  They tell models apart; they don't name one."""
    return F.coalesce(F.substring(vin(chassis), 1, 8), otherwise)
