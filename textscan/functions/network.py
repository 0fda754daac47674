"""IP addresses, networks and hosts as native Column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from textscan.functions.regexes import let, to_jvm

# --- Fixed values: special-purpose address blocks (IANA registries) -----------
_PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
]
_NOT_PRIVATE_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
_SHARED_V4 = ["100.64.0.0/10"]
_PRIVATE_V6 = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16",
    "fc00::/7", "fe80::/10",
]
_NOT_PRIVATE_V6 = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
]
_RESERVED_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "A000::/3",
    "C000::/3", "E000::/4", "F000::/5", "F800::/6", "FE00::/9",
]
_IPV4_LENIENT = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
_IPV6_LENIENT = r"^(([0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|(([0-9a-fA-F]{1,4}:){1,7}:|(:[0-9a-fA-F]{1,4}){1,7}))$"
# ------------------------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_regex() -> str:
    """All spellings of an IPv6 address: n groups before '::', what is left after
    it, with the last two groups possibly in dotted form."""
    group, tail = "[0-9a-fA-F]{1,4}", rf"(?:[0-9a-fA-F]{{1,4}}:[0-9a-fA-F]{{1,4}}|{_QUAD})"
    forms = [rf"(?:{group}:){{6}}{tail}"]
    for before in range(8):
        head = rf"{group}(?::{group}){{{before - 1}}}" if before else ""
        room = 7 - before
        after = [rf"(?:{group}(?::{group}){{0,{room - 1}}})?"] if room else [""]
        if room >= 2:
            lead = rf"(?:{group}:){{0,{room - 2}}}"
            after.insert(0, rf"{lead}{_QUAD}")
        forms += [rf"{head}::{a}" for a in after]
    return r"\A(?:" + "|".join(forms) + r")\z"


IPV4 = rf"\A{_QUAD}\z"
IPV6 = _ipv6_regex()
IPV4_OR_CIDR = rf"\A{_QUAD}(?:/0*(?:3[0-2]|[12]?[0-9]))?\z"


def is_ipv4(address: Column) -> Column:
    return address.rlike(IPV4)


def is_ipv6(address: Column) -> Column:
    return address.rlike(IPV6)


def is_mac_address(address: Column) -> Column:
    return address.rlike(to_jvm(r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$"))


def ipv4_number(address: Column) -> Column:
    """A dotted quad as bigint; null if it is none."""
    parts = F.split(address, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))
    return F.when(is_ipv4(address), number)


def ipv6_hex(address: Column) -> Column:
    """An IPv6 address (zone allowed) as 32 lower-case hex digits; null if it is none."""
    plain = F.regexp_replace(address, "%[^%]+$", "")

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def expand(full: Column) -> Column:
        halves = F.split(full, "::")
        right = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        return let(
            F.struct(groups(halves[0]).alias("l"), groups(right).alias("r")),
            lambda s: F.array_join(
                F.transform(
                    F.concat(s["l"], F.array_repeat(F.lit("0"), F.lit(8) - F.size(s["l"]) - F.size(s["r"])), s["r"]),
                    lambda g: F.lpad(F.lower(g), 4, "0"),
                ),
                "",
            ),
        )

    def undotted(text: Column) -> Column:
        quad = F.regexp_substr(text, F.lit(rf"{_QUAD}$"))
        number = ipv4_number(quad)
        tail = F.lpad(F.hex(number), 8, "0")
        return F.when(quad.isNull(), text).otherwise(
            F.concat(F.regexp_replace(text, rf"{_QUAD}$", ""), tail.substr(1, 4), F.lit(":"), tail.substr(5, 4))
        )

    return F.when(is_ipv6(plain), let(undotted(plain), expand))


def _in_v4(number: Column, blocks: list[str]) -> Column:
    inside = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        inside = inside | number.between(int(block.network_address), int(block.broadcast_address))
    return inside


def _in_v6(digits: Column, blocks: list[str]) -> Column:
    inside = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        inside = inside | digits.between(f"{int(block[0]):032x}", f"{int(block[-1]):032x}")
    return inside


def _mapped_v4(digits: Column) -> Column:
    """The IPv4 number inside ::ffff:a.b.c.d; null otherwise."""
    return F.when(
        digits.startswith("0" * 20 + "ffff"), F.conv(digits.substr(25, 8), 16, 10).cast("long")
    )


def _by_version(address: Column, v4, v6) -> Column:
    """v4(number) or v6(hex digits), false for anything else.  The IPv6 side is
    only looked at for texts with a colon."""
    six = let(ipv6_hex(address), lambda h: F.coalesce(v6(h), F.lit(False)))
    four = let(ipv4_number(address), lambda n: F.coalesce(v4(n), F.lit(False)))
    return F.when(address.isNull(), None).when(F.contains(address, F.lit(":")), six).otherwise(four)


def _private_v4(n: Column) -> Column:
    return _in_v4(n, _PRIVATE_V4) & ~_in_v4(n, _NOT_PRIVATE_V4)


def _private_v6(h: Column) -> Column:
    return F.coalesce(_private_v4(_mapped_v4(h)), _in_v6(h, _PRIVATE_V6) & ~_in_v6(h, _NOT_PRIVATE_V6))


def is_private_ip(address: Column) -> Column:
    return _by_version(address, _private_v4, _private_v6)


def is_public_ip(address: Column) -> Column:
    """Globally reachable and not private; the shared block 100.64/10 is neither."""
    return _by_version(
        address, lambda n: ~_private_v4(n) & ~_in_v4(n, _SHARED_V4), lambda h: ~_private_v6(h)
    )


def is_loopback_ip(address: Column) -> Column:
    v4 = ["127.0.0.0/8"]
    return _by_version(
        address,
        lambda n: _in_v4(n, v4),
        lambda h: F.coalesce(_in_v4(_mapped_v4(h), v4), _in_v6(h, ["::1/128"])),
    )


def is_multicast_ip(address: Column) -> Column:
    return _by_version(address, lambda n: _in_v4(n, ["224.0.0.0/4"]), lambda h: _in_v6(h, ["ff00::/8"]))


def is_reserved_ip(address: Column) -> Column:
    return _by_version(address, lambda n: _in_v4(n, ["240.0.0.0/4"]), lambda h: _in_v6(h, _RESERVED_V6))


def is_broadcast_ip(address: Column, network: Column | str = "255.255.255.255") -> Column:
    """Whether an IPv4 address is the last one of a network (``a.b.c.d`` or
    ``a.b.c.d/n``; host bits may be set)."""
    network = F.lit(network) if isinstance(network, str) else network
    base = ipv4_number(F.substring_index(network, "/", 1))
    bits = F.when(F.contains(network, F.lit("/")), F.split(network, "/")[1].try_cast("int")).otherwise(F.lit(32))
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("long")
    last = base - base % size + size - 1
    valid = bits.between(0, 32)
    return F.when(address.isNull(), None).otherwise(
        F.coalesce(F.when(valid, ipv4_number(address) == last), F.lit(False))
    )


def is_cidr(cidr: Column) -> Column:
    """address/prefix with a prefix in range."""
    parts = F.split(cidr, "/")
    prefix = F.replace(F.get(parts, F.lit(1)), F.lit("_"), F.lit("")).try_cast("int")
    address = parts[0]
    fits = (is_ipv4(address) & prefix.between(0, 32)) | (is_ipv6(address) & prefix.between(0, 128))
    return F.when(cidr.isNull(), None).otherwise(F.coalesce((F.size(parts) == 2) & fits, F.lit(False)))


def ip_type(address: Column) -> Column:
    """IPv4, IPv6 or Invalid by the lenient shapes (leading zeros in a quad pass;
    '::' only at the end, or a lone leading colon)."""
    return (
        F.when(address.isNull(), None)
        .when(address.rlike(to_jvm(_IPV4_LENIENT)), "IPv4")
        .when(address.rlike(to_jvm(_IPV6_LENIENT)), "IPv6")
        .otherwise("Invalid")
    )


def is_hostname(name: Column) -> Column:
    """At most 253 characters; labels of 1 to 63 characters without a hyphen."""
    labels_fit = F.forall(F.split(name, r"\."), lambda label: F.length(label).between(1, 63))
    return (F.length(name) <= 253) & ~F.contains(name, F.lit("-")) & labels_fit
