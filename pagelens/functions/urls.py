"""URL functions as column expressions: parts, validation, anatomy and normal forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a host or path that stand for a risk, and host names that are never fetched.
RISK_WORDS = ["login-update", "account-verify", "secure-banking", "wallet-connect", "auth-confirm", "password-reset", "security-alert", "paypal-verify", "appleid-verify", "chase-online", "wellsfargo-verify", "binance-security", "metamask-auth", "webscr"]
RESERVED_HOSTS = r"(^|\.)localhost$|\.(local|localsite|internal|intranet|test|example|invalid|lan|home)$|^metadata\.goog$"
ALLOWED_PORTS = ["", "80", "443"]
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
#: A last label that makes a host an address, and an address of one to four parts in decimal, octal or hexadecimal.
NUMERIC = r"(^|\.)([0-9]+|0x[0-9a-f]*)$"
IPV4 = r"^(0x[0-9a-f]*|0[0-7]*|[1-9][0-9]*)(\.(0x[0-9a-f]*|0[0-7]*|[1-9][0-9]*)){0,3}$"
#: Signs that no host may have once it is decoded.
FORBIDDEN = r"[\s#/:<>?@\\^|%\[\]]"
ASSET = r"(?i)\.(css|js|png|jpe?g|gif|svg|webp|avif|ico|woff2?|ttf|eot|map|json|xml|txt|pdf|zip)$"


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """`make` of a value that is worked out once, however often the result names it."""
    return F.get(F.transform(F.array(value), make), 0)


def with_scheme(url: Column) -> Column:
    url = F.trim(F.coalesce(url, F.lit("")))
    return F.when(url.rlike(SCHEME), url).otherwise(F.concat(F.lit("https://"), url))


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority_of(url), "^.*@", ""), r":[0-9]*$", ""))


def port_of(url: Column) -> Column:
    """The port, '' where it is the scheme's own."""
    port = F.regexp_extract(authority_of(url), r":([0-9]+)$", 1)
    own = ((scheme_of(url) == "http") & (port == "80")) | ((scheme_of(url) == "https") & (port == "443"))
    return F.when(own, "").otherwise(port)


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def decoded_host(url: Column) -> Column:
    """The host with percent-encodings decoded; one that is malformed keeps its sign."""
    host = host_of(url)
    good = (F.regexp_replace(host, "%[0-9a-f]{2}", "").contains("%") == F.lit(False)) & host.contains("%")
    decoded = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(host, r"\+", "%2B")), host))
    return F.regexp_replace(F.when(good, decoded).otherwise(host), r"\.$", "")


def number_of(part: Column) -> Column:
    """The value of a part of an address; longer than any valid one is only large."""
    base = F.when(part.startswith("0x"), 16).when(part.startswith("0") & (F.length(part) > 1), 8).otherwise(10)
    digits = F.when(part.startswith("0x"), F.substring(part, 3, 40)).otherwise(F.substring(part, 1, 40))
    return F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0.0), lambda t, c: t * base + F.instr(F.lit("0123456789abcdef"), c) - 1)


def is_ipv4(host: Column) -> Column:
    """Whether a host is an IPv4 address in any spelling: the last part fills what the others leave."""
    parts = F.split(host, r"\.")
    small = F.forall(F.slice(parts, 1, F.size(parts) - 1), lambda p: number_of(p) <= 255)
    return F.when(host.rlike(IPV4), small & (number_of(F.element_at(parts, -1)) < F.pow(F.lit(256.0), 5 - F.size(parts)))).otherwise(F.lit(False))


def validation(raw: Column) -> Column:
    """A struct (code, message); code is `ok`, `INVALID_URL` or `BLOCKED_TARGET`.  The first reason counts."""
    first = F.struct(F.trim(F.coalesce(raw, F.lit(""))).alias("trimmed"), with_scheme(raw).alias("url"))
    parts = lambda x: {"trimmed": x["trimmed"], "scheme": scheme_of(x["url"]), "authority": authority_of(x["url"]), "port": port_of(x["url"]), "written": host_of(x["url"]), "host": decoded_host(x["url"])}
    return bound(first, lambda x: bound(F.struct(*(v.alias(k) for k, v in parts(x).items())), _judged))


def _judged(x: Column) -> Column:
    """The verdict on the parts of an address."""
    trimmed, host = x["trimmed"], x["host"]
    literal = x["written"].contains(":") | x["written"].startswith("[")
    port = F.regexp_extract(x["authority"], r":([0-9]+)$", 1)
    unreadable = (x["authority"] == "") | (~literal & (host.rlike(FORBIDDEN) | (host.rlike(NUMERIC) & ~is_ipv4(host)))) | (F.length(port) > 5) | ((F.length(port) == 5) & (port > "65535"))
    bad = lambda cond, message, code="INVALID_URL": (cond, F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))
    ladder = [
        bad(trimmed == "", "Empty URL"),
        bad(F.length(trimmed) > 2048, "URL too long"),
        bad(trimmed.rlike("[\\s<>\"'`]"), "URL contains invalid characters"),
        bad(unreadable, "Cannot parse URL"),
        bad(x["authority"].contains("@"), "URLs with user credentials are not allowed"),
        bad(~x["scheme"].isin("http", "https"), F.concat(F.lit("Unsupported scheme: "), x["scheme"], F.lit(":"))),
        bad(~x["port"].isin(*ALLOWED_PORTS), F.concat(F.lit("Non-standard port: "), x["port"])),
        bad(host == "", "Missing hostname"),
        bad(is_ipv4(host) | literal, "Direct IP access is not allowed", "BLOCKED_TARGET"),
        bad(host.rlike(RESERVED_HOSTS), "Private or reserved hostname", "BLOCKED_TARGET"),
    ]
    out = F.struct(F.lit("ok").alias("code"), F.lit(None).cast("string").alias("message"))
    for cond, value in reversed(ladder):
        out = F.when(cond, value).otherwise(out)
    return out


def anatomy(raw: Column) -> dict[str, Column]:
    """Host, protocol and the signs of a risky URL."""
    url = with_scheme(raw)
    host, path = host_of(url), F.lower(path_of(url))
    found = F.filter(F.array(*map(F.lit, RISK_WORDS)), lambda w: host.contains(w) | path.contains(w))
    return {
        "hostname": host,
        "protocol": scheme_of(url),
        "is_ip": host.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | host.contains(":"),
        "is_punycode": host.startswith("xn--") | host.contains(".xn--"),
        "subdomains": F.greatest(F.lit(0), F.size(F.filter(F.split(host, r"\."), lambda x: x != "")) - 2),
        "risk_words": F.array_join(found, ","),
        "unusual_port": ~port_of(url).isin(*ALLOWED_PORTS),
    }


def normal_url(url: Column) -> Column:
    """Without fragment, trailing slashes (but for the root) and with the host lower-cased."""
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    port = port_of(url)
    return F.concat(scheme_of(url), F.lit("://"), host_of(url), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)


def whole(url: Column) -> Column:
    """An address as it is asked for: scheme and host in lower case, without credentials and the scheme's own port."""

    def made(u: Column) -> Column:
        port = bound(port_of(u), lambda p: F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)))
        return F.concat(scheme_of(u), F.lit("://"), host_of(u), port, path_of(u), F.regexp_extract(u, r"^[^?#]*([?#].*)", 1))

    return bound(with_scheme(url), made)


def first_segment(url: Column) -> Column:
    return F.concat(F.lit("/"), F.coalesce(F.get(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), 0), F.lit("/")))


def resolved(link: Column, base: Column) -> Column:
    """An absolute, protocol-relative, root-relative or plain relative link against a base URL."""
    origin = F.concat(scheme_of(base), F.lit("://"), authority_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(link.rlike(SCHEME), link)
        .when(link.startswith("//"), F.concat(scheme_of(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .otherwise(F.concat(origin, folder, link))
    )


def cache_key(url: Column, with_query: bool) -> Column:
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.concat(key, F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)) if with_query else key


def domain_of(text: Column) -> Column:
    """A domain from what a person typed: without scheme, path, www., port and outer dots."""
    x = F.lower(F.trim(text))
    for pattern in (r"^[a-z][a-z0-9+.-]*://", r"[/?#].*$", r"^www\.", r":[0-9]+$", r"^\.+|\.+$"):
        x = F.regexp_replace(x, pattern, "")
    return F.when(x.rlike(r"^([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}$"), x)
