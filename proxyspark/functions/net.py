"""IP address expressions: canonical text, sortable keys, subnet tests.

Spark has no network type. Addresses are kept as canonical text, and ordering
or containment goes through a numeric (v4) or 16-byte (v6) key that can be
stored next to the text and pushed down to the scan.
"""

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.try_cast("bigint"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def _v6_flat(low: Column) -> Column:
    """A dotted v4 tail written as two hexadecimal groups."""
    number = _v4_number(F.regexp_extract(low, rf":({_V4})$", 1))
    as_hex = _let(number, lambda n: F.concat(
        F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536))))
    return F.when(low.rlike(rf":{_V4}$"), F.concat(F.regexp_replace(low, rf"{_V4}$", ""), as_hex)).otherwise(low)


def _v6_groups(text: Column) -> Column:
    """Eight hexadecimal groups without leading zeros, or NULL when malformed."""
    def side(half):
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(halves):
        left, right = side(F.get(halves, 0)), side(F.coalesce(F.get(halves, 1), F.lit("")))
        return _let(F.struct(left.alias("l"), right.alias("r"), F.size(halves).alias("n")), lambda p: F.when(
            F.when(p["n"] == 2, F.size(p["l"]) + F.size(p["r"]) <= 7)
            .otherwise((p["n"] == 1) & (F.size(p["l"]) == 8)),
            F.concat(p["l"], F.array_repeat(F.lit("0"), 8 - F.size(p["l"]) - F.size(p["r"])), p["r"])))

    groups = _let(F.split(_v6_flat(F.lower(text)), "::"), filled)
    return _let(groups, lambda g: F.when(
        F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
        F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))))


def _v6_text(text: Column) -> Column:
    def dotted(pair):
        numbers = F.transform(pair, lambda g: F.conv(g, 16, 10).try_cast("int"))
        octets = F.flatten(F.transform(numbers, lambda n: F.array(
            F.floor(n / 256).cast("string"), (n % 256).cast("string"))))
        return F.concat(F.lit("::ffff:"), F.array_join(octets, "."))

    def written(joined):
        # Longest run of zero groups, the first one on ties, is written '::'.
        shortened = [
            F.when(joined.rlike(rf"(^|:)0(:0){{{run - 1}}}(:|$)"), F.regexp_replace(
                joined, rf"^(.*?)(?:^|(?<!^):)0(?::0){{{run - 1}}}(?::|$)", "$1::"))
            for run in range(8, 1, -1)
        ]
        return F.coalesce(*shortened, joined)

    return _let(_v6_groups(text), lambda g: F.when(
        F.array_join(F.slice(g, 1, 6), ":") == "0:0:0:0:0:ffff", dotted(F.slice(g, 7, 2))
    ).otherwise(_let(F.array_join(g, ":"), written)))


def parse_ip(text: Column) -> Column:
    """Canonical v4 or v6 text, or NULL. A v6 zone suffix is kept."""
    zone = F.regexp_extract(text, "(%.+)$", 1)
    bare = F.regexp_replace(text, "%.+$", "")
    return (
        F.when(text.rlike(rf"^{_V4}$"), text)
        .when(F.contains(text, F.lit(":")), F.concat(_v6_text(bare), zone))
    )


def ip_v4_key(ip: Column) -> Column:
    return F.when(ip.rlike(rf"^{_V4}$"), _v4_number(ip))


def ip_v6_key(ip: Column) -> Column:
    bare = F.regexp_replace(ip, "%.+$", "")
    padded = F.array_join(F.transform(_v6_groups(bare), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(F.contains(ip, F.lit(":")), F.unhex(padded))


def ip_key(ip: Column) -> Column:
    """One key for both families that sorts as addresses do, v4 first: the family's
    number, then the address's bytes. A zone suffix has no part in it."""
    v4 = F.concat(F.lit("04"), F.lpad(F.hex(_v4_number(ip)), 8, "0"))
    return F.when(ip.rlike(rf"^{_V4}$"), F.unhex(v4)).when(
        F.contains(ip, F.lit(":")), F.concat(F.unhex(F.lit("06")), ip_v6_key(ip)))


def key_in_cidr(key: Column, cidr: str) -> Column:
    """A range of ``ip_key`` values, which a stored key lets the scan test."""
    net = ipaddress.ip_network(cidr, strict=False)
    low, high = (bytearray(bytes([net.version]) + a.packed) for a in (net.network_address, net.broadcast_address))
    return (key >= F.lit(low)) & (key <= F.lit(high))


def ip_in_cidr(ip: Column, cidr: str) -> Column:
    """True when ``ip`` lies in ``cidr``; a range test on the sortable key."""
    net = ipaddress.ip_network(cidr, strict=False)
    low, high = net.network_address, net.broadcast_address
    if net.version == 4:
        return F.coalesce(ip_v4_key(ip).between(int(low), int(high)), F.lit(False))
    key = ip_v6_key(ip)
    inside = (key >= F.lit(bytearray(low.packed))) & (key <= F.lit(bytearray(high.packed)))
    return F.coalesce(inside, F.lit(False))
