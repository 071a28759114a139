"""DNS header flags: bit layout and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (RFC 1035, RFC 6895): code -> name.
OPCODE_NAMES = {
    0: "QUERY",
    1: "IQUERY",
    2: "STATUS",
    3: "RESERVED",
    4: "NOTIFY",
    5: "UPDATE",
    6: "DSO",
}
RCODE_NAMES = {
    0: "NOERROR",
    1: "FORMERR",
    2: "SERVFAIL",
    3: "NXDOMAIN",
    4: "NOTIMP",
    5: "REFUSED",
    6: "YXDOMAIN",
    7: "YXRRSET",
    8: "NXRRSET",
    9: "NOTAUTH",
    10: "NOTZONE",
}

# Field -> (lowest bit, width) in the 16-bit flags word.
HEADER_BITS = {
    "qr": (15, 1),
    "opcode": (11, 4),
    "aa": (10, 1),
    "tc": (9, 1),
    "rd": (8, 1),
    "ra": (7, 1),
    "rcode": (0, 4),
}


def unpack_header(word: Column) -> dict[str, Column]:
    """Columns qr, opcode, aa, tc, rd, ra, rcode of a 16-bit flags word."""
    return {
        name: F.shiftright(word, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias(name)
        for name, (low, width) in HEADER_BITS.items()
    }


def pack_header(fields: dict[str, Column]) -> Column:
    """The 16-bit flags word of integer columns named as in `HEADER_BITS`."""
    word = F.lit(0)
    for name, (low, _) in HEADER_BITS.items():
        word = word.bitwiseOR(F.shiftleft(fields[name].cast("int"), low))
    return word


def _named(column: str, names: dict[int, str]) -> str:
    """SQL text: name of a code, UNKNOWN(code) where it has none."""
    table = ", ".join(f"'{names[code]}'" for code in sorted(names))
    return f"coalesce(get(array({table}), {column}), concat('UNKNOWN(', {column}, ')'))"


def flag_names() -> Column:
    """Struct of the seven flags as text, from the columns named as in `HEADER_BITS`."""

    def truth(bit: str) -> str:
        return f"'{bit}', CASE WHEN {bit} != 0 THEN 'TRUE' ELSE 'FALSE' END"

    return F.expr(f"""named_struct(
        'qr', CASE WHEN qr != 0 THEN 'RESPONSE' ELSE 'QUERY' END,
        'opcode', {_named("opcode", OPCODE_NAMES)},
        {truth("aa")}, {truth("tc")}, {truth("rd")}, {truth("ra")},
        'rcode', {_named("rcode", RCODE_NAMES)})""")


def flags_text(flags: Column) -> Column:
    """One indented `key: value` line per flag."""
    return F.concat_ws(
        "\n",
        *[F.concat(F.lit(f"  {key}: "), flags.getField(key)) for key in HEADER_BITS],
    )
