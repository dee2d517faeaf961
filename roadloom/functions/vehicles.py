"""Vehicle identification numbers and fault codes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard for vehicle identification numbers: letters with their numbers, weights by place, check characters.
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_NUMBERS = "12345678123457923456789"
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_CHECKS = "0123456789X"
# Systems of fault codes by the two high bits.
FAULT_SYSTEMS = "PCBU"


def vin_check_character(vin: Column) -> Column:
    """The check character that the other characters ask for: the weighted sum of their numbers modulo 11, X for 10."""
    digits = F.split(F.translate(vin, VIN_LETTERS, VIN_NUMBERS), "")
    weighted = F.zip_with(digits, F.lit(VIN_WEIGHTS), lambda d, w: d.try_cast("int") * w)
    return F.substr(F.lit(VIN_CHECKS), F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 11 + 1, F.lit(1))


def vin_reason(vin: Column) -> Column:
    """Why a number is refused, or null: missing, its length (a blank one's too), its characters (no I, O, Q, no lower case), its
    check character."""
    return (
        F.when(vin.isNull(), "VIN_MISSING")
        .when(F.length(vin) != 17, "VIN_LENGTH")
        .when(~vin.rlike("^[0-9A-HJ-NPR-Z]{17}$"), "VIN_ILLEGAL_CHAR")
        .when(vin_check_character(vin) != F.substr(vin, F.lit(9), F.lit(1)), "VIN_CHECK_DIGIT")
    )


def vin_maker(vin: Column) -> Column:
    """The world manufacturer identifier."""
    return F.substr(vin, F.lit(1), F.lit(3))


def vin_from_parts(maker: Column, descriptor: Column, serial: Column) -> Column:
    """A valid number: three characters of the maker, five of the descriptor, and eight of the rest after the check character."""
    open_ = F.concat(maker, descriptor, F.lit("0"), serial)
    return F.concat(maker, descriptor, vin_check_character(open_), serial)


def fault_code(raw: Column) -> Column:
    """A canonical code from text such as p0301 or from four hexadecimal digits; null where it is neither."""
    text = F.upper(F.trim(raw))
    digits = F.regexp_extract(text, "^(?:0X)?([0-9A-F]{4})$", 1)
    bits = F.conv(digits, 16, 10).cast("int")
    system = F.substr(F.lit(FAULT_SYSTEMS), F.shiftright(bits, 14) + 1, F.lit(1))
    decoded = F.concat(system, F.shiftright(bits, 12).bitwiseAND(3).cast("string"), F.substr(digits, F.lit(2), F.lit(3)))
    return F.when(text.rlike("^[PCBU][0-3][0-9A-F]{3}$"), text).when(digits != "", decoded)


def fault_code_raw(code: Column) -> Column:
    """The number of a canonical code, the inverse of decoding it."""
    system = F.position(F.substr(code, F.lit(1), F.lit(1)), F.lit(FAULT_SYSTEMS)) - 1
    return system * 16384 + F.substr(code, F.lit(2), F.lit(1)).cast("int") * 4096 + F.conv(F.substr(code, F.lit(3), F.lit(3)), 16, 10).cast("int")


def fault_codes_in(text: Column) -> Column:
    """The codes in a free text, in capitals, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b([PCBU][0-3][0-9A-F]{3})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))
