"""IPv4 helpers. Addresses are bigint in network order unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ip_from_text(text: Column) -> Column:
    """Dotted text, zero padding allowed, to bigint; null when it is not an address."""
    parts = F.split(text, "[.]")
    octets = F.transform(
        parts, lambda p: F.when(p.rlike(r"\A[0-9]+\z"), p.try_cast("int"))
    )
    valid = (F.size(parts) == 4) & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False)))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
    return F.when(valid, number)


def ip_to_text(ip: Column) -> Column:
    """Bigint to dotted text."""
    return F.concat_ws(
        ".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    )


def endpoint_id(ip: Column) -> Column:
    """Identifier of a directly reachable endpoint: the octets in little-endian order."""
    octet = lambda s: F.shiftright(ip, s).bitwiseAND(F.lit(255))
    return octet(24) + octet(16) * 256 + octet(8) * 65536 + octet(0) * 16777216


# First and last address of the blocks that are not routable.
_UNSPECIFIED = [(0, 0)]
_LOOPBACK = [(0x7F000000, 0x7FFFFFFF)]
_PRIVATE = [(0x0A000000, 0x0AFFFFFF), (0xAC100000, 0xAC1FFFFF), (0xC0A80000, 0xC0A8FFFF)]
_LINK_LOCAL = [(0xA9FE0000, 0xA9FEFFFF)]
_BROADCAST = [(0xFFFFFFFF, 0xFFFFFFFF)]
_MULTICAST = [(0xE0000000, 0xEFFFFFFF)]


def _outside(ip: Column, blocks: list[tuple[int, int]]) -> Column:
    ok = F.lit(True)
    for first, last in blocks:
        ok = ok & ~ip.between(first, last)
    return ok


def is_routable(ip: Column) -> Column:
    """Worth probing from outside."""
    return _outside(ip, _UNSPECIFIED + _LOOPBACK + _PRIVATE + _LINK_LOCAL + _BROADCAST)


def is_public_peer(ip: Column) -> Column:
    """Acceptable as a directory peer (multicast is refused, link-local is not looked at)."""
    return _outside(ip, _UNSPECIFIED + _LOOPBACK + _PRIVATE + _MULTICAST + _BROADCAST)


def join_size(high: Column, low: Column) -> Column:
    """64-bit size from two 32-bit halves."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint"))


def size_low(size: Column) -> Column:
    return size.bitwiseAND(F.lit(4294967295))


def size_high(size: Column) -> Column:
    return F.shiftrightunsigned(size, 32)
