"""EDNS options: the code-length-value list of an OPT record, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namestrata.functions.ip import ip_text
from namestrata.functions.once import let

# Option codes.
NSID, SUBNET, COOKIE, PADDING, ERROR = 3, 8, 10, 12, 15
ALGORITHMS = (5, 6, 7)

OPTION = "STRUCT<code: INT, hex: STRING>"


def _number(hexa: Column, at: Column | int, digits: int) -> Column:
    return F.conv(F.substring(hexa, F.lit(at), F.lit(digits)), 16, 10).cast("int")


def options(rdata: Column) -> Column:
    """(code, value as hex) of every option of an OPT record whose data is ``\\# length hex``.

    A last option that is cut short is left out; no data, or a NULL, gives an empty list.
    """
    hexa = F.coalesce(F.get(F.split(rdata, " "), F.lit(2)), F.lit(""))

    def walk(data: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.array().cast(f"ARRAY<{OPTION}>").alias("found"))

        def step(state: Column, _: Column) -> Column:
            size = _number(data, state["at"] + 4, 4) * 2
            option = F.struct(
                _number(data, state["at"], 4).alias("code"), F.substring(data, state["at"] + 8, size).alias("hex")
            )
            after = F.struct(
                (state["at"] + 8 + size).alias("at"), F.concat(state["found"], F.array(option)).alias("found")
            )
            return F.when(F.length(data) >= state["at"] + 7 + size, after).otherwise(state)

        # An option takes four bytes at least, so this many steps see them all.
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(data) / 8).cast("int")))
        return F.aggregate(steps, start, step)["found"]

    return let(hexa, walk)


def subnet_address(hexa: Column) -> Column:
    """Address of a client subnet option; bytes left out are zero, family 0 stands for 0.0.0.0."""
    family, bits = _number(hexa, 1, 4), F.substring(hexa, F.lit(9), F.length(hexa))
    full = F.when(family == 1, F.rpad(bits, 8, "0")).when(family == 2, F.rpad(bits, 32, "0"))
    return ip_text(F.unhex(F.when(family == 0, "00000000").otherwise(full)))


def option_json(option: Column, quote, obj) -> Column:
    """One option as JSON; ``quote`` and ``obj`` write a string and an object.

    Client subnet, cookie, name server id, algorithm lists, padding and extended errors have members of
    their own; all others, and a subnet or error too short for its head, give code and data in Base64.
    """
    code, hexa = option["code"], option["hex"]

    def text(value: Column) -> Column:
        return value.cast("string")

    def hex_digits(value: Column) -> Column:
        return quote(F.lower(value))

    data = quote(F.regexp_replace(F.base64(F.unhex(hexa)), r"\s", ""))
    head = F.length(hexa) >= 8
    subnet = obj(
        ("Code", text(code)), ("Family", text(_number(hexa, 1, 4))), ("SourceNetmask", text(_number(hexa, 5, 2))),
        ("SourceScope", text(_number(hexa, 7, 2))), ("Address", quote(subnet_address(hexa))),
    )
    extra = F.try_to_binary(F.substring(hexa, F.lit(5), F.length(hexa)), F.lit("hex"))
    error = obj(("InfoCode", text(_number(hexa, 1, 4))), ("ExtraText", quote(F.decode(extra, "UTF-8"))))
    return (
        F.when((code == SUBNET) & head & _number(hexa, 1, 4).isin(0, 1, 2), subnet)
        .when(code == COOKIE, obj(("Code", text(code)), ("Cookie", hex_digits(hexa))))
        .when(code == NSID, obj(("Code", text(code)), ("Nsid", hex_digits(hexa))))
        .when(code.isin(*ALGORITHMS), obj(("Code", text(code)), ("AlgCode", data)))
        .when(code == PADDING, obj(("Padding", data)))
        .when((code == ERROR) & (F.length(hexa) >= 4), error)
        .otherwise(obj(("Code", text(code)), ("Data", data)))
    )
