"""Address and telephone functions on columns, all from built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed


def decode_protected_email(code: Column) -> Column:
    """The address that a hexadecimal code protects (its first byte is the key of the others), or null."""
    pair = lambda c, i: F.conv(F.substring(c, i, F.lit(2)), 16, 10).cast("int")

    def decoded(c: Column, key: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(2), (F.length(c) / 2).cast("int")), lambda i: F.char(pair(c, 2 * i - 1).bitwiseXOR(key)))
        return F.when((F.length(c) >= 4) & c.rlike("^([0-9a-fA-F]{2})+$"), F.array_join(chars, ""))

    # The code, its key and the address are made once each: an expression that stands in a lambda is worked out again for every element.
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    email = once(code, lambda c: once(pair(c, F.lit(1)), lambda key: decoded(c, key)))
    return once(email, lambda e: F.when(e.rlike(f"^{fixed.EMAIL}$"), e))


def norm_email(email: Column) -> Column:
    e = F.coalesce(F.try_url_decode(F.replace(email, F.lit("+"), F.lit("%2B"))), email)
    e = F.lower(F.regexp_replace(F.trim(e), r"^[.,;:()<>\[\]\"']+|[.,;:()<>\[\]\"']+$", ""))
    return F.regexp_replace(e, "^(mailto:|email:)", "")


def valid_email(email: Column, bad_parts=fixed.BAD_EMAIL_PARTS) -> Column:
    """Well formed, not a placeholder, not a file name. ``bad_parts`` are substrings that rule an address out."""
    low = F.lower(email)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    clean = low.isNotNull()
    for part in bad_parts:
        clean = clean & ~F.contains(low, F.lit(part))
    dots = F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit("")))
    return F.coalesce(
        email.rlike(f"^{fixed.EMAIL}$") & (F.length(email) <= 80) & clean & ~(local.rlike("^(u00|x|%)") & (F.length(local) < 3)) & ~local.rlike(r"\d{6,}") & (dots <= 4) & tld.rlike("^[a-z]{2,24}$") & ~tld.isin(*fixed.ASSET_TLDS),
        F.lit(False),
    )


def valid_obfuscated(email: Column, bad_parts=fixed.BAD_EMAIL_PARTS, tlds=tuple(fixed.KNOWN_TLDS)) -> Column:
    return valid_email(email, bad_parts) & F.substring_index(F.lower(email), ".", -1).isin(*tlds)


def emails_on_page(html: Column, text: Column, bad_parts=fixed.BAD_EMAIL_PARTS) -> Column:
    """array of struct(email, source) over five channels, in the order mailto, protected, text, obfuscated, markup; null texts are empty."""
    html, text = F.coalesce(html, F.lit("")), F.coalesce(text, F.lit(""))
    found = lambda values, source: F.transform(values, lambda e: F.struct(e.alias("email"), F.lit(source).alias("source")))
    every = lambda s, p, g: F.regexp_extract_all(s, F.lit(p), F.lit(g))
    mailto = F.transform(F.flatten(F.transform(every(html, r'(?i)href="mailto:([^"?]+)', 1), lambda x: F.split(x, ","))), norm_email)
    protected = F.transform(every(html, r'(?:data-cfemail="|/cdn-cgi/l/email-protection#)([0-9a-fA-F]{6,})', 1), lambda c: F.lower(decode_protected_email(c)))
    at, dot = fixed.AT_MARK, fixed.DOT_MARK
    hidden = rf"(?i)([A-Za-z0-9._%+\-]+\s*(?:{at}|\s+at\s+)\s*[A-Za-z0-9\-]+(?:\s*(?:{dot}|\s+dot\s+|\.)\s*[A-Za-z0-9\-]+)+)"
    marked = F.filter(every(text, hidden, 1), lambda x: x.rlike(rf"(?i){at}|{dot}|\s+dot\s+"))
    spelled = F.transform(marked, lambda x: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, rf"(?i)\s*(?:{dot}|\s+dot\s+)\s*", "."), rf"(?i)\s*(?:{at}|\s+at\s+)\s*", "@"), r"\s+", "")))
    markup = F.transform(every(html, r'"email"\s*:\s*"([^"]+@[^"]+)"', 1), norm_email)
    plain = F.transform(every(text, f"({fixed.EMAIL})", 1), norm_email)
    channels = F.concat(found(mailto, "mailto"), found(protected, "cloudflare"), found(plain, "text"), found(F.filter(spelled, lambda e: valid_obfuscated(e, bad_parts)), "obfuscated"), found(markup, "jsonld"))
    return F.filter(channels, lambda x: valid_email(x["email"], bad_parts))


def local_bucket(email: Column) -> Column:
    """0 a person, 1 to 3 a role, the more general the higher, 4 an address nobody sells at."""
    local = F.substring_index(email, "@", 1)
    return F.when(local.isin(*fixed.LOW_VALUE_LOCALS), 4).when(local.isin("hello", "hi", "hey"), 1).when(local.isin("info", "contact", "team", "partnerships", "inquiries", "enquiries"), 2).when(local.isin(*fixed.ROLE_LOCALS), 3).otherwise(0)


def email_confidence(kind: Column, source: Column, same_domain: Column, email: Column, email_domain: Column, freemail=fixed.FREEMAIL) -> Column:
    c = F.lit(0.45) + F.when(kind == "contact", 0.25).when(kind == "home", 0.15).when(kind == "about", 0.1).otherwise(0.0)
    c = c + F.when(same_domain, 0.25).otherwise(0.0) + F.when(source.isin("mailto", "cloudflare"), 0.1).otherwise(0.0)
    c = c - F.when(F.substring_index(email, "@", 1).isin(*fixed.LOW_VALUE_LOCALS), 0.2).otherwise(0.0) - F.when(~same_domain & ~email_domain.isin(*freemail), 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.98), c))


def phones_in(text: Column) -> Column:
    """Telephone numbers of 9 to 15 digits, not one digit repeated, not a date; each once, in order."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({fixed.PHONE})"), F.lit(1)), lambda x: F.trim(x))

    def good(s: Column) -> Column:
        digits = F.regexp_replace(s, r"\D", "")
        return F.length(digits).between(9, 15) & (F.replace(digits, F.substring(digits, 1, 1), F.lit("")) != "") & ~s.rlike(r"(19|20)\d{2}[-/.](0?\d|1[0-2])")

    return F.array_distinct(F.filter(raw, good))


def booking_score(url: Column, anchor: Column, own_site: Column) -> Column:
    """How likely a link books a meeting: a scheduler 5, an own page of that name 3, a telling anchor 1 more."""
    low = F.lower(url)
    base = F.when(low.rlike(fixed.BOOKING_HOST), 5).when(own_site & low.rlike(fixed.BOOKING_PATH), 3).otherwise(0)
    return base + F.when(F.lower(F.coalesce(anchor, F.lit(""))).rlike(fixed.BOOKING_ANCHOR), 1).otherwise(0)


def verification(n_hosts: Column, smtp_open: Column, code: Column, message: Column, catch_all: Column) -> Column:
    """The verdict on an address from its domain's mail hosts and the answer to a probe."""
    gone = code.isin(550, 551, 553) | ((code == 554) & F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit("no such")))
    return (
        F.when(F.coalesce(n_hosts, F.lit(0)) == 0, "no_mx")
        .when(~F.coalesce(smtp_open, F.lit(False)) | code.isNull(), "mx_valid")
        .when(code.between(200, 299), F.when(F.coalesce(catch_all, F.lit(False)), "catch_all").otherwise("smtp_valid"))
        .when(gone, "invalid")
        .otherwise("mx_valid")
    )
