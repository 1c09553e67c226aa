"""Indicators of compromise as column expressions: masking undone, extracted, typed, hinted at, normalised."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchglass.functions import patterns as P
from watchglass.functions.text import filled, let


def refang(text: Column) -> Column:
    """Masked indicators as they were meant (``hxxp[://]evil[.]com``); invisible characters are taken out."""
    out = seen = F.when(text.rlike(f"[{P.INVISIBLE}]"), F.translate(text, P.INVISIBLE, "")).otherwise(text)
    for pattern, replacement in P.REFANG:
        out = F.regexp_replace(out, pattern, replacement)
    # What every one of the patterns needs; most texts have none of it.
    return F.when(seen.rlike(r"(?i)\[[.:/d:a]|\([.da]|\{[.da]|hxxp|hxtp|fxp|[．＠：／]"), out).otherwise(seen)


def defang(text: Column) -> Column:
    """URLs and dots masked, so that nothing can be clicked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\bhttp(s?)://", "hxxp$1://"), r"(?<=\w)\.(?=\w)", "[.]")


def _whole(pattern: str) -> str:
    flags = "(?iU)" if pattern.startswith("(?i)") else "(?U)"
    return rf"{flags}^(?:{pattern.removeprefix('(?i)')})$(?!\n)"


def _within(pattern: str) -> str:
    flags = "(?iU)" if pattern.startswith("(?i)") else "(?U)"
    return rf"{flags}\b(?:{pattern.removeprefix('(?i)')})\b"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _where(needed: Column, found: Column) -> Column:
    """Matches, sought only where a text has what each of them needs."""
    return F.when(needed, found).otherwise(F.array().cast("array<string>"))


def is_ipv4(text: Column) -> Column:
    return text.rlike(rf"^(?:{P.IPV4})$(?!\n)")


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    parts = F.split(address, r"\.")
    number = F.lit(0)
    for i in range(4):
        number = number + F.get(parts, F.lit(i)).try_cast("bigint") * (1 << (24 - 8 * i))
    return F.when(is_ipv4(address), number)


def within_nets(address: Column, nets: tuple[str, ...]) -> Column:
    number, found = ipv4_number(address), F.lit(False)
    for net in map(ipaddress.ip_network, nets):
        found = found | number.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(found, F.lit(False))


def is_private_ipv4(address: Column) -> Column:
    return within_nets(address, P.PRIVATE_NETS)


def is_ipv6(text: Column) -> Column:
    """Whether a text is an IPv6 address, as the ``ipaddress`` module takes it: scope and IPv4 tail allowed."""
    bare = F.regexp_replace(text, r"(?<=.)%[^%]+$", "")
    tail = rf"(?<=:){P.IPV4}$"
    plain = F.regexp_replace(bare, tail, "1:1")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    doubled = plain.contains("::")
    shape = plain.rlike(r"^[0-9A-Fa-f:]+$(?!\n)") & ~plain.rlike(r"[0-9A-Fa-f]{5}|:::|::.*::|^:[^:]|[^:]:$|^:$")
    return shape & plain.contains(":") & F.when(doubled, groups <= 7).otherwise(groups == 8)


def _is_loopback6(text: Column) -> Column:
    return text.rlike(r"^[0:]*:0{0,3}1(?:%.*)?$")


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)


def is_null_hash(digest: Column) -> Column:
    low = F.lower(digest)
    return low.rlike("^(?:0+|f+)$") | low.isin(*P.EMPTY_HASHES)


def top_level(domain: Column) -> Column:
    return F.lower(F.substring_index(domain, ".", -1))


def extract_indicators(text: Column) -> Column:
    """All indicators in a text, different ones in code-point order; an empty array for none or null."""

    def found(t: Column) -> Column:
        colon, hexadecimal = t.contains(":"), t.rlike("[0-9A-Fa-f]{32}")
        urls = F.transform(_where(t.contains("://"), _all(t, "(?iU)" + P.URL.removeprefix("(?i)"))), lambda u: F.regexp_replace(u, P.URL_TAIL, ""))
        urls = F.filter(urls, lambda u: F.length(u) > F.length(F.substring_index(u, "://", 1)) + 3)
        ipv4 = F.filter(_where(t.rlike(r"(?U)\d\.\d"), _all(t, _within(P.IPV4))), lambda a: ~is_private_ipv4(a))
        ipv6 = F.filter(_where(colon, _all(t, "(?U)" + P.IPV6)), lambda a: is_ipv6(a) & ~_is_loopback6(a))
        domains = F.filter(_where(t.rlike(r"[A-Za-z0-9]\.[A-Za-z0-9]"), _all(t, _within(P.DOMAIN))), lambda d: ~top_level(d).isin(*P.INTERNAL_TLDS))
        emails = _where(t.contains("@"), _all(t, _within(P.EMAIL)))
        files = _where(t.rlike(r"[A-Za-z0-9_\-]\.[A-Za-z]"), _all(t, _within(P.FILENAME)))
        first = F.concat(urls, emails, ipv4, ipv6, domains, files, _where(colon, _all(t, _within(P.SSDEEP))), _where(hexadecimal, _all(t, _within(P.TLSH))))

        def hashes(before: Column, lengths: tuple[int, ...]) -> Column:
            """Adds hashes, longest first; one that a longer candidate starts with is left out."""
            if not lengths:
                return before
            seen = F.filter(F.transform(_where(hexadecimal, _all(t, rf"(?U)\b[0-9a-fA-F]{{{lengths[0]}}}\b")), F.lower), lambda h: ~is_null_hash(h))
            fresh = F.filter(seen, lambda h: ~F.exists(before, lambda e: F.startswith(e, h) & (F.length(e) > F.length(h))))
            return let(F.concat(before, fresh), lambda all_found: hashes(all_found, lengths[1:]))

        known = let(first, lambda f: hashes(f, tuple(P.HEX_LENGTHS.values())))
        rest = F.concat(
            F.filter(F.transform(_where(hexadecimal, _all(t, P.KEYED_HASH, 1)), F.lower), lambda h: ~is_null_hash(h)),
            F.transform(_where(t.contains("-"), _all(t, _within(P.CVE))), F.upper),
            _where(t.contains("T1"), _all(t, _within(P.TECHNIQUE))),
            F.transform(_where(t.contains("\\"), _all(t, r"(?iU)\b" + P.REGISTRY.removeprefix("(?i)"))), lambda k: F.regexp_replace(k, P.REGISTRY_TAIL, "")),
            F.transform(_where(t.rlike("[A-Za-z0-9+/=]{100}"), _all(t, P.ENCODED, 1)), lambda b: F.concat(F.lit(P.ENCODED_PREFIX), b)),
        )
        return F.array_sort(F.array_distinct(F.concat(known, rest)))

    return let(refang(F.coalesce(text, F.lit(""))), found)


def indicator_type(value: Column) -> Column:
    """One of 16 types, or ``unknown``; the most specific pattern that fits the whole value decides."""
    out = F.when(F.startswith(value, F.lit(P.ENCODED_PREFIX)), "ps_encoded")
    for name, test in (
        ("cve", value.rlike(_whole(P.CVE))),
        ("mitre_technique", value.rlike(_whole(P.TECHNIQUE))),
        ("registry_key", value.rlike(_whole(P.REGISTRY))),
        ("url", value.rlike(_whole(P.URL))),
        ("email", value.rlike(_whole(P.EMAIL))),
        ("ip", is_ip(value)),
        ("ssdeep", value.rlike(_whole(P.SSDEEP))),
        ("tlsh", value.rlike(_whole(P.TLSH))),
        *((name, value.rlike(rf"^[0-9a-fA-F]{{{n}}}$(?!\n)") & ~is_null_hash(value)) for name, n in P.HEX_LENGTHS.items()),
        ("filename", value.rlike(_whole(P.FILENAME))),
        ("domain", value.rlike(_whole(P.DOMAIN)) & ~top_level(value).isin(*P.INTERNAL_TLDS)),
    ):
        out = out.when(test, name)
    return F.when(value.isNotNull(), out.otherwise("unknown"))


def typed(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), indicator_type(v).alias("type")))


def host_of(value: Column) -> Column:
    """Host of a URL or domain in lower case, without scheme, user, port, path, query and fragment."""
    s = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    s = F.regexp_replace(s, r"^(?s:.*?)://", "")
    s = F.regexp_replace(s, r"^[^@]*@", "")
    return F.regexp_extract(s, r"^[^/?#:]*", 0)


def severity_hint(value: Column) -> Column:
    """``critical``, ``high`` or null: what an indicator alone says."""
    kind, host = indicator_type(value), host_of(value)
    registry = F.lit(False)
    for fragment in P.PERSISTENCE:
        registry = registry | value.rlike("(?i)" + fragment)
    network = F.lit(False)
    for suffix in P.TUNNELS:
        network = network | F.endswith(host, F.lit(suffix))
    network = network | host.isin(*P.PASTE_HOSTS) | (host.isin(*P.CONTROL_HOSTS) & (kind == "url") & value.rlike(P.CONTROL_PATH))
    return (
        F.when(F.startswith(value, F.lit(P.ENCODED_PREFIX)), "critical")
        .when((kind == "registry_key") & registry, "high")
        .when(kind.isin("url", "domain") & network, "high")
    )


def valid_techniques(ids: Column) -> Column:
    """Technique ids in upper case without white space around, those of the right form, first ones first."""
    clean = F.transform(F.array_distinct(ids), lambda t: F.upper(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    return F.filter(clean, lambda t: t.rlike(P.ANY_TECHNIQUE))


def metric_type(value: Column) -> Column:
    """The coarser types that metrics count by; they are not those of ``indicator_type``."""
    digits, n = value.rlike("^[0-9a-fA-F]*$"), F.length(value)
    colon = value.contains(":") & ~F.startswith(value, F.lit("["))
    bare = F.substring_index(value, "%", 1)
    return (
        F.when(value.contains("://") | value.rlike("^(?:http|ftp)"), "url")
        .when(value.contains("@"), "email")
        .when(colon & is_ipv6(bare), "ipv6")
        .when(colon, "unknown")
        .when(is_ipv4(value), "ipv4")
        .when(digits & (n == 32), "md5")
        .when(digits & (n == 40), "sha1")
        .when(digits & (n == 64), "sha256")
        .when(digits, "hash")
        .when(value.contains("."), "domain")
        .otherwise("unknown")
    )


def cache_key(value: Column) -> Column:
    """An indicator in the form that lookups are remembered by: hashes in lower case, schemes unmasked."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed.rlike("^[0-9a-fA-F]{32,128}$"), F.lower(trimmed)).otherwise(F.regexp_replace(trimmed, r"(?i)^hxxp(s?)://", "http$1://"))


def encoded_stub(value: Column, unit: str = "B", digits: int = 16, mark: str = "") -> Column:
    """An encoded payload's name without the payload: digits of its SHA-256 and its size."""
    payload = F.regexp_replace(F.substring(value, len(P.ENCODED_PREFIX) + 1, 1 << 30), "=+$", "")
    raw = F.try_to_binary(payload, F.lit("base64"))
    size = F.coalesce(F.octet_length(raw).cast("string"), F.lit("?"))
    named = F.concat(F.lit(P.ENCODED_PREFIX), F.coalesce(F.substring(F.sha2(raw, 256), 1, digits), F.lit("invalid")), F.lit(f"{mark} ("), size, F.lit(f"{unit})"))
    return F.when(F.startswith(value, F.lit(P.ENCODED_PREFIX)), named).otherwise(value)


def collect_text(raw_json: Column, *fields: Column) -> Column:
    """The text that indicators are sought in: filled fields and every string value inside the raw JSON."""
    tokens = F.filter(_all(F.coalesce(raw_json, F.lit("")), r'"(?:[^"\\]|\\.)*+"\s*:?'), lambda t: ~F.endswith(t, F.lit(":")))  # keys go
    values = F.transform(tokens, lambda t: F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0)))
    return F.array_join(F.concat(F.filter(F.array(*[filled(f) for f in fields]), lambda x: x.isNotNull()), F.filter(values, lambda x: x.isNotNull())), "\n")


def enrich(raw_json: Column, fields: list[Column], source_ip: Column, dest_ip: Column, known: Column) -> Column:
    """Indicators of an alert: found in its texts, its addresses even if private, and those it came with."""
    given = F.filter(F.array(source_ip, dest_ip), lambda a: a.isNotNull() & is_ip(a))
    return F.array_sort(F.array_distinct(F.concat(extract_indicators(collect_text(raw_json, *fields)), given, F.coalesce(known, F.array().cast("array<string>")))))
