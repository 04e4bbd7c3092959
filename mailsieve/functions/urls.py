"""URL and domain functions as columns. All stay in the JVM; a null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
#: Words, suffixes, brands and characters that rules look for.
SENSITIVE_WORDS = ["secure", "account", "webscr", "login", "ebayisapi", "signin", "banking", "confirm", "update", "verify", "password", "suspend", "paypal", "authenticate", "wallet", "credential"]
SUSPICIOUS_EXTENSIONS = ["exe", "zip", "rar", "scr", "bat", "cmd", "msi", "dll", "vbs", "js", "jar", "ps1", "wsf", "lnk", "7z", "cab"]
SPECIAL_CHARS = "!@#$%^&*~`|\\<>{}"
BRAND_SUBSTRINGS = ["paypal", "microsoft", "google", "amazon", "apple", "facebook", "instagram", "netflix", "github", "linkedin", "outlook", "icloud", "youtube", "whatsapp", "chase", "wellsfargo", "citibank", "dropbox", "discord", "spotify"]
SHORTENERS = ["bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "rb.gy", "shorturl.at", "t.ly", "tiny.cc"]
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "com.br", "com.cn", "net.cn", "org.cn", "co.in", "co.za", "com.mx", "com.sg", "com.hk", "com.tr", "co.kr", "or.kr"]
CHAR_PROBABILITY = {
    "0": 0.0078637338, "1": 0.0101679180, "2": 0.0074502294, "3": 0.0055957308, "4": 0.0051794522, "5": 0.0056410549, "6": 0.0042180731, "7": 0.0037996455, "8": 0.0035634913, "9": 0.0034425618,
    "a": 0.0589765190, "b": 0.0161821154, "c": 0.0611543036, "d": 0.0312923155, "e": 0.0691772970, "f": 0.0130443973, "g": 0.0212382157, "h": 0.0523380601, "i": 0.0441889406, "j": 0.0033305019, "k": 0.0105264083, "l": 0.0302732653, "m": 0.0474257857,
    "n": 0.0475272179, "o": 0.0740223276, "p": 0.0671214968, "q": 0.0031705390, "r": 0.0420973890, "s": 0.0487208050, "t": 0.1232198563, "u": 0.0242928657, "v": 0.0134484462, "w": 0.0179498731, "x": 0.0070832213, "y": 0.0098243925, "z": 0.0054515532,
}


def _part(u: Column, k: int) -> Column:
    return F.regexp_extract(u, PARTS, k)


def with_scheme(u: Column) -> Column:
    """The trimmed URL, with http:// in front unless it has a scheme."""
    u = F.trim(u)
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("http://"), F.regexp_replace(u, "^//", "")))


def scheme(u: Column) -> Column:
    return F.lower(_part(u, 1))


def host(u: Column) -> Column:
    """Lower-cased host name without user, port and IPv6 brackets; '' if there is none."""
    authority = F.regexp_replace(_part(u, 2), r"^.*@", "")
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"^\[|\]$", ""))


def port(u: Column) -> Column:
    return F.regexp_extract(_part(u, 2), r":(\d+)$", 1)


def path(u: Column) -> Column:
    return _part(u, 3)


def query(u: Column) -> Column:
    return F.regexp_replace(_part(u, 4), r"^\?", "")


def fragment(u: Column) -> Column:
    return F.regexp_replace(_part(u, 5), "^#", "")


def normalize_url(u: Column) -> Column:
    """Scheme and host lower-cased, port kept, a lone / dropped; null for empty or hostless input."""
    full = with_scheme(u)
    p = F.when(path(full) == "/", "").otherwise(path(full))
    out = F.concat(scheme(full), F.lit("://"), host(full), F.when(port(full) != "", F.concat(F.lit(":"), port(full))).otherwise(""), p, _part(full, 4), _part(full, 5))
    return F.when((F.trim(u) != "") & (host(full) != ""), out)


def extract_domain(u: Column) -> Column:
    """Host of a full URL; null if it has none."""
    h = host(F.trim(u))
    return F.when(h != "", h)


def normalize_domain(d: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(d)), r"^(\*\.)+", ""), r"\.+$", "")


def is_url(u: Column) -> Column:
    u = F.trim(u)
    return F.coalesce((host(u) != "") & scheme(u).isin("http", "https"), F.lit(False))


def canonicalize_url(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(u)), "^http://", "https://")


def tld_label(d: Column) -> Column:
    return F.when(F.instr(d, ".") > 0, F.substring_index(d, ".", -1)).otherwise("")


def is_ip(h: Column) -> Column:
    return h.rlike(IPV4) | h.contains(":")


def registrable_domain(h: Column) -> Column:
    """Registrable domain by the last two labels, or three under a two-label suffix; addresses and single labels as they are."""
    h = F.lower(F.trim(h))
    return F.when(is_ip(h), h).when(F.substring_index(h, ".", -2).isin(TWO_LABEL_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))


def registrable_label(h: Column) -> Column:
    return F.substring_index(registrable_domain(h), ".", 1)


def split_tld(h: Column) -> Column:
    """struct(domain, subdomain, tld) of a host."""
    r = registrable_domain(h)
    label = F.substring_index(r, ".", 1)
    has = F.instr(r, ".") > 0
    return F.when(is_ip(h), F.struct(h.alias("domain"), F.lit("").alias("subdomain"), F.lit("").alias("tld"))).otherwise(
        F.struct(label.alias("domain"), F.when(F.length(h) > F.length(r), F.substring(h, 1, F.length(h) - F.length(r) - 1)).otherwise("").alias("subdomain"), F.when(has, F.substring(r, F.length(label) + 2, F.length(r))).otherwise("").alias("tld"))
    )



def entropy(s: Column) -> Column:
    """Shannon entropy in bits over characters; 0 for empty."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.length(s).cast("double")
    of = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double") / n
    return F.when(F.length(s) == 0, 0.0).otherwise(F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - of(c) * F.log2(of(c))))


def count_of(s: Column, what: str) -> Column:
    """Non-overlapping occurrences of a text."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))) / len(what)).cast("int")


def count_class(s: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{chars}]", ""))


def longest_run(s: Column, chars: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(f"([{chars}]+)"), 1), F.length)), F.lit(0))


def char_probability(s: Column) -> Column:
    """Mean table probability over letters and digits."""
    table = F.create_map(*[F.lit(x) for kv in CHAR_PROBABILITY.items() for x in kv])
    chars = F.filter(F.split(F.lower(s), ""), lambda c: c.rlike(r"^[\p{L}\p{Nd}]$"))
    total = F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.coalesce(F.element_at(table, c), F.lit(0.0)))
    return F.when(F.size(chars) > 0, total / F.size(chars)).otherwise(0.0)


def subdomain_brand(h: Column) -> Column:
    """First brand that a label of four characters or more has inside, labels first, then brands in list order; null if none."""
    brands = F.array(*[F.lit(b) for b in BRAND_SUBSTRINGS])
    labels = F.filter(F.split(F.lower(h), r"\."), lambda x: F.length(x) >= 4)
    hits = F.flatten(F.transform(labels, lambda x: F.filter(brands, lambda b: F.contains(x, b))))
    return F.get(hits, 0)


def is_shortener(h: Column) -> Column:
    return registrable_domain(h).isin(SHORTENERS)


def is_public_ip(ip: Column) -> Column:
    """An IPv4 address that isn't private, loopback, link-local, shared, multicast or unspecified."""
    inside = r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|2(2[4-9]|3\d|[45]\d)\.)"
    return F.coalesce(ip.rlike(IPV4) & ~ip.rlike(inside), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a long; null for others."""
    p = F.split(ip, r"\.")
    return F.when(ip.rlike(IPV4), sum(F.get(p, i).cast("long") * (1 << (8 * (3 - i))) for i in range(4)))


def cidr_range(c: Column) -> tuple[Column, Column]:
    """First and last address of an IPv4 block, as longs."""
    bits = F.substring_index(c, "/", -1).cast("int")
    size = F.shiftleft(F.lit(1).cast("long"), 32 - bits)
    base = ipv4_number(F.substring_index(c, "/", 1))
    return base - base % size, base - base % size + size - 1


def url_features(u: Column) -> list[Column]:
    """The lexical URL features, in model order, as named columns."""
    s, full = F.trim(u), with_scheme(u)
    h, p, q = host(full), path(full), query(full)
    t = split_tld(h)
    subs = F.filter(F.split(t["subdomain"], r"\."), lambda x: x != "")
    digits = count_class(s, "0-9")
    n = F.length(s)
    words = sum(count_of(F.lower(s), w) for w in SENSITIVE_WORDS)
    special = F.length(s) - F.length(F.translate(s, SPECIAL_CHARS, ""))
    runs = longest_run(s, r"\p{L}") + longest_run(s, r"\p{Nd}") + longest_run(s, r"^\p{L}\p{Nd}")
    depth = F.greatest(count_of(p, "/") - 1, F.lit(0))
    sub_len = F.aggregate(subs, F.lit(0), lambda a, x: a + F.length(x))
    out = {
        "url_length": n, "num_dots": count_of(s, "."), "num_subdomains": F.size(subs), "num_hyphens_url": count_of(s, "-"), "num_hyphens_hostname": count_of(h, "-"), "https_flag": (scheme(full) == "https").cast("int"),
        "entropy_url": F.round(entropy(s), 6), "num_numeric_chars": digits, "num_sensitive_words": words, "hostname_length": F.length(h), "path_length": F.length(p), "url_char_prob": F.round(char_probability(s), 8),
        "char_continuation_rate": F.round(runs / n, 6), "entropy_domain": F.round(entropy(t["domain"]), 6), "num_query_params": F.when(q != "", F.size(F.split(q, "&"))).otherwise(0), "num_special_chars": special,
        "at_symbol_present": s.contains("@").cast("int"), "pct_numeric_chars": F.round(digits / F.greatest(n, F.lit(1)), 6), "suspicious_file_ext": F.lower(p).rlike(r"\.(" + "|".join(SUSPICIOUS_EXTENSIONS) + ")$").cast("int"),
        "path_depth": depth, "num_underscores": count_of(s, "_"), "query_length": F.length(q), "has_fragment": (fragment(full) != "").cast("int"), "has_repeated_digits": s.rlike(r"(\d)\1{2}").cast("int"),
        "avg_subdomain_length": F.round(F.when(F.size(subs) > 0, sub_len / F.size(subs)).otherwise(0.0), 6), "tld_length": F.length(t["tld"]), "token_count": F.size(F.filter(F.split(s, r"[/?&=\-_.:@#+~%]"), lambda x: x != "")),
    }
    return [c.alias(k) for k, c in out.items()]
