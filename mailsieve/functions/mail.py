"""Header, address and body functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Free mail providers, impersonated brands, mailers and security headers.
FREE_PROVIDERS = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.jp", "ymail.com", "rocketmail.com", "icloud.com", "me.com", "mac.com", "aol.com", "protonmail.com", "proton.me", "pm.me", "tutanota.com", "gmx.com", "gmx.de", "gmx.net", "yandex.com", "yandex.ru", "mail.ru", "inbox.ru", "list.ru", "bk.ru", "zoho.com", "fastmail.com", "fastmail.fm", "hushmail.com", "naver.com", "qq.com", "163.com", "126.com", "sina.com", "sina.cn"]
BRANDS = ["paypal.com", "amazon.com", "apple.com", "microsoft.com", "google.com", "gmail.com", "netflix.com", "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "github.com", "dropbox.com", "adobe.com", "docusign.com", "office.com", "office365.com", "icloud.com", "outlook.com", "hotmail.com", "yahoo.com", "chase.com", "bankofamerica.com", "wellsfargo.com", "citibank.com", "hsbc.com", "barclays.com", "americanexpress.com", "dhl.com", "fedex.com", "ups.com", "usps.com"]
HIDDEN_TEXT = [
    r"(?is)display\s*:\s*none", r"(?is)visibility\s*:\s*hidden", r"(?is)font-size\s*:\s*0(px|pt|em|rem|vh|vw|vmin|vmax|%)?(?:[;\"'\s}]|$)", r"(?is)<[^>]*\shidden(\s|>|=)",
    r"(?is)(left|top|text-indent)\s*:\s*-\s*\d{3,}\s*px", r"(?is)(^|[;{\s\"'])(width|height|max-height)\s*:\s*0(px|pt|em|%)?(?:[;\"'\s}]|$)", r"(?is)opacity\s*:\s*0(\.0+)?(?:[;\"'\s}]|$)",
]
WHITE = r"(#?f{3,6}\b|white\b|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))"


def auth_result(header: Column, method: str) -> Column:
    """The first value of spf, dkim, dmarc or arc in an Authentication-Results header; '' if absent."""
    return F.lower(F.regexp_extract(header, rf"(?i)(^|[ \t;,]){method}=([^ ;]+)", 2))


def normalize_auth(v: Column) -> Column:
    v = F.lower(F.trim(v))
    return F.when(v.isNull() | (v == ""), "").when(v == "pass", "pass").when(v.isin("fail", "permerror", "perm-error"), "fail").when(v.isin("softfail", "soft-fail"), "softfail").otherwise("none")


def domain_of(addr: Column) -> Column:
    """Domain of an address, with or without display name and angle brackets; a bare domain is itself."""
    v = F.trim(addr)
    inner = F.when(v.rlike(r"<[^>]+>"), F.regexp_extract(v, r"<([^>]+)>", 1)).otherwise(v)
    after = F.regexp_replace(F.trim(F.lower(F.trim(F.substring_index(inner, "@", -1)))), r"^\.+|\.+$|>$", "")
    return F.when(F.instr(inner, "@") > 0, after).otherwise(F.lower(F.regexp_replace(F.trim(inner), "^<|>$", "")))


def address_only(addr: Column) -> Column:
    v = F.trim(addr)
    return F.lower(F.when(v.rlike(r"<[^>]+>"), F.regexp_extract(v, r"<([^>]+)>", 1)).otherwise(v))


def same_registrable_domain(a: Column, b: Column) -> Column:
    """Equal, or one below the other where the shorter has a dot."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    below = lambda x, y: F.endswith(x, F.concat(F.lit("."), y)) & (F.instr(y, ".") > 0)
    return F.coalesce((a != "") & (b != "") & ((a == b) | below(a, b) | below(b, a)), F.lit(False))


def suffixes(d: Column) -> Column:
    """The domain and all its parents."""
    labels = F.split(d, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_free_provider(d: Column) -> Column:
    d = F.regexp_replace(F.lower(F.trim(d)), r"\.$", "")
    return F.coalesce((d != "") & F.arrays_overlap(suffixes(d), F.array(*[F.lit(x) for x in FREE_PROVIDERS])), F.lit(False))


def candidate_labels(d: Column) -> Column:
    """The domain, its parents of two labels or more, and hyphen tokens of three characters or more with the TLD; distinct, in that order."""
    whole = F.filter(suffixes(d), lambda s: F.contains(s, F.lit(".")))
    base = F.array_distinct(F.concat(F.array(d), whole))
    tld = F.substring_index(d, ".", -1)
    first = F.filter(F.transform(base, lambda s: F.substring_index(s, ".", 1)), lambda x: F.contains(x, F.lit("-")))
    tokens = F.filter(F.transform(F.flatten(F.transform(first, lambda x: F.split(x, "-"))), lambda x: F.trim(x)), lambda x: F.length(x) >= 3)
    extra = F.transform(tokens, lambda x: F.concat(x, F.lit("."), tld))
    return F.when(F.instr(d, ".") > 0, F.array_distinct(F.concat(base, extra))).otherwise(F.array(d))


def message_id(v: Column) -> Column:
    return F.regexp_replace(F.trim(v), "^<+|>+$", "")


def hop_count(received: Column) -> Column:
    return F.size(received)


def time_drift_hours(hops: Column, sent: Column) -> Column:
    """Hours from the sent time to the latest hop; both in epoch seconds."""
    return (F.array_max(hops) - sent) / 3600.0


def contains_non_ascii(s: Column) -> Column:
    return F.coalesce(s.rlike(r"[^\x00-\x7F]"), F.lit(False))


def suspicious_mailer(s: Column) -> Column:
    return F.coalesce(F.lower(s).rlike("phpmailer|mass ?mail|bulk ?mail|the bat!|sendblaster|python|curl"), F.lit(False))


def has_html(s: Column) -> Column:
    return s.rlike(r"(?is)<\s*(html|body|table|div|p|a|span|td|tr|br|img)\b")


def has_form(s: Column) -> Column:
    return s.rlike(r"(?is)<\s*form\b")


def has_hidden_text(s: Column) -> Column:
    any_of = F.lit(False)
    for p in HIDDEN_TEXT:
        any_of = any_of | s.rlike(p)
    return any_of | (s.rlike(rf"(?is)color\s*:\s*{WHITE}") & s.rlike(rf"(?is)background(-color)?\s*:\s*{WHITE}"))


def encoding_anomaly(charset: Column, body: Column) -> Column:
    """A claim of ASCII that the body breaks, or over 2 % control characters in a body of 200 characters or more."""
    ctrl = F.length(F.regexp_replace(body, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    claim = F.lower(F.trim(charset)).isin("us-ascii", "ascii") & contains_non_ascii(body)
    return F.coalesce(claim, F.lit(False)) | F.coalesce((F.length(body) >= 200) & (ctrl / F.length(body) > 0.02), F.lit(False))


def domain_age_days(created: Column, as_of: Column) -> Column:
    """Whole days since a date text in any of the usual layouts; null if unreadable or in the future."""
    layouts = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy", "yyyy.MM.dd", "yyyy/MM/dd", "MM/dd/yyyy"]
    at = F.coalesce(*[F.try_to_timestamp(created, F.lit(x)) for x in layouts])
    days = F.floor((as_of.cast("timestamp").cast("long") - at.cast("long")) / 86400)
    return F.when(days >= 0, days)


def normalise_subject(s: Column) -> Column:
    """Lower-cased, without reply and warning prefixes, ids and addresses and numbers as placeholders."""
    s = F.regexp_replace(F.lower(s), r"^(\s*(re:|fwd:|fw:|\[external\]|\[ext\]|\[spam\])\s*)+", "")
    s = F.regexp_replace(s, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{uuid}")
    s = F.regexp_replace(s, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "{email}")
    return F.trim(F.regexp_replace(s, r"[0-9]{3,}", "{n}"))


def fingerprint(sender: Column, url_domain: Column, subject: Column, intent: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(sender), F.lower(url_domain), F.sha2(normalise_subject(subject), 256), F.lower(intent)), 256)


def urls_in_text(s: Column) -> Column:
    """http(s) URLs in reading order, without trailing punctuation."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(?i)(https?://[^\s<>\"']+)"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}'\"]+$", ""))


def collapse_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))


def html_to_text(s: Column) -> Column:
    """Text of HTML: scripts, styles, head and comments go, block ends become line breaks, blanks collapse."""
    s = F.regexp_replace(s, r"(?is)<!--.*?-->|<(script|style|head|title|noscript|template)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?i)<\s*(br|/p|/div|/li|/tr|/h[1-6]|/table|/ul|/ol)\s*/?>", "\n")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[ \t\x0B\f\r]+", " "), r" ?\n[ \n]*", "\n"))


def scrub(s: Column) -> Column:
    """Valid UTF-8 without NUL."""
    return F.replace(F.make_valid_utf8(s), F.lit("\x00"), F.lit(""))
