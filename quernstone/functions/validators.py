"""Predicates.  check_x(c, ...) is struct<ok, code, message>; is_x(c, ...) is a boolean for filters.

Rules are tried in order and the first that fails is told; a null value fails with the first rule of its validator.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of the patterns of host names.
_UL = "¡-￿"
_HOST = rf"[a-z{_UL}0-9](?:[a-z{_UL}0-9-]{{0,61}}[a-z{_UL}0-9])?"
_SUB = rf"(?:\.(?!-)[a-z{_UL}0-9-]{{1,63}}(?<!-))*"
_TLD = rf"\.(?!-)(?:[a-z{_UL}-]{{2,63}}|xn--[a-z0-9]{{1,59}})(?<!-)\.?"
_ASCII = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.(?!-)[a-zA-Z0-9-]{1,63}(?<!-))*\.(?!-)(?:[a-zA-Z0-9-]{2,63})(?<!-)\.?"
_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
URL = rf"(?i)^[a-z0-9.+-]+://(?:[^\s:@/]+(?::[^\s:@/]*)?@)?(?:{IPV4}|\[[0-9a-f:.]+\]|(?:{_HOST}{_SUB}{_TLD}|localhost))(?::[0-9]{{1,5}})?(?:[/?#][^\s]*)?\z"
SCHEMES = ("http", "https", "ftp", "ftps")


def _first_failure(*rules: tuple[Column, str, str | Column]) -> Column:
    """rules: (holds, code, message)."""
    code = message = None
    for holds, c, m in rules:
        bad = ~F.coalesce(holds, F.lit(False))
        m = m if isinstance(m, Column) else F.lit(m)
        code = F.when(bad, F.lit(c)) if code is None else code.when(bad, F.lit(c))
        message = F.when(bad, m) if message is None else message.when(bad, m)
    return F.struct(code.isNull().alias("ok"), code.alias("code"), message.alias("message"))


def check_regex(c: Column, pattern: str, inverse: bool = False, code: str = "invalid", message: str = "Enter a valid value.") -> Column:
    """Whether the pattern is found anywhere; inverse: isn't."""
    found = c.rlike(pattern)
    return _first_failure((~found if inverse else found, code, message))


def check_integer(c: Column) -> Column:
    return check_regex(c, r"^-?\d+\z", code="invalid_integer", message="Enter a valid integer.")


def check_slug(c: Column) -> Column:
    return check_regex(c, r"^[a-zA-Z0-9_-]+\z", code="invalid_slug", message="Enter a valid 'slug' consisting of letters, numbers, underscores or hyphens.")


def check_unicode_slug(c: Column) -> Column:
    return check_regex(c, r"(?U)^[-\w]+\z", code="invalid_unicode_slug", message="Enter a valid 'slug' consisting of Unicode letters, numbers, underscores, or hyphens.")


def check_int_list(c: Column, separator: str = ",", negative: bool = False) -> Column:
    one = r"-?\d+" if negative else r"\d+"
    return check_regex(c, rf"^{one}(?:\Q{separator}\E{one})*\z", code="invalid_list", message=f"Enter only integers separated by '{separator}'.")


def _label_lengths(c: Column, most: int = 63) -> Column:
    return F.forall(F.split(F.regexp_replace(c, r"\.+$", ""), r"\.", -1), lambda x: F.length(x) <= most)


def _punycodes(s: pd.Series) -> pd.Series:
    def one(x):
        try:
            return x if x is None or x.isascii() else x.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return s.map(one)


def punycode(c: Column) -> Column:
    """A domain in its ASCII form; what has none is null."""
    return F.pandas_udf(_punycodes, "string")(c)


def _ascii_form(c: Column) -> Column:
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(punycode(c))


def check_domain(c: Column, idna: bool = True) -> Column:
    message = "Enter a valid domain name."
    rules = [(c.isNotNull(), "invalid", message), (F.length(c) <= 255, "max_length", F.concat(F.lit("Ensure this value has at most 255 characters (it has "), F.length(c), F.lit(").")))]
    if not idna:
        rules.append((c.rlike(r"^[\x00-\x7F]*\z"), "invalid", "Enter a valid ASCII domain name."))
    rules.append((c.rlike(rf"(?i)^{_HOST}{_SUB}{_TLD}\z" if idna else rf"^{_ASCII}\z"), "invalid", message))
    labels = _ascii_form(c) if idna else c
    rules += [(labels.isNotNull(), "invalid", message), (_label_lengths(labels), "max_label_length", "Domain labels cannot be longer than 63 characters.")]
    return _first_failure(*rules)


def _are_ipv6(s: pd.Series) -> pd.Series:
    def one(x) -> bool:
        try:
            return x is not None and bool(ipaddress.IPv6Address(x))
        except ValueError:
            return False

    return s.map(one).astype(bool)


def is_ipv6(c: Column) -> Column:
    return F.pandas_udf(_are_ipv6, "boolean")(c)


def is_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"^{IPV4}\z"), F.lit(False))


def check_ipv4(c: Column) -> Column:
    return _first_failure((is_ipv4(c), "invalid_ipv4", "Enter a valid IPv4 address."))


def _maybe_ipv6(c: Column) -> Column:
    """Only what looks like an IPv6 address goes to Python."""
    return F.when(c.rlike(r"^[0-9a-fA-F:.%\w]*:[0-9a-fA-F:.%\w]*\z"), is_ipv6(c)).otherwise(F.lit(False))


def check_ipv6(c: Column) -> Column:
    return _first_failure((_maybe_ipv6(c), "invalid_ipv6", "Enter a valid IPv6 address."))


def check_ip(c: Column) -> Column:
    return _first_failure((is_ipv4(c) | _maybe_ipv6(c), "invalid_ip", "Enter a valid IPv4 or IPv6 address."))


def _host(c: Column) -> Column:
    """The host of a URL, without user, port and brackets, in small letters."""
    rest = F.regexp_extract(c, r"^[^:]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""), r"^\[|\]$", ""))


def check_url(c: Column, schemes: tuple[str, ...] = SCHEMES) -> Column:
    scheme, host = F.lower(F.split(c, "://", 2)[0]), _host(c)
    literal = c.rlike(r"^[^:]*://(?:[^/?#@]*@)?\[")
    return _first_failure(
        (c.isNotNull(), "invalid_type", "Enter a valid URL."),
        (F.length(c) <= 2048, "max_length", F.concat(F.lit("Ensure this URL has at most 2048 characters (it has "), F.length(c), F.lit(")."))),
        (~c.rlike(r"[\t\r\n]"), "unsafe_chars", "URL contains unsafe characters (tabs, newlines)."),
        (scheme.isin(*schemes), "invalid_scheme", F.concat(F.lit("URL scheme '"), scheme, F.lit(f"' is not allowed. Allowed schemes: {', '.join(schemes)}"))),
        (c.rlike(URL), "invalid_url", "Enter a valid URL."),
        (~literal | _maybe_ipv6(host), "invalid_ipv6_in_url", "Enter a valid IPv6 address part in the URL."),
        (F.length(_ascii_form(host)) <= 253, "hostname_too_long", F.concat(F.lit("Hostname '"), F.substring(host, 1, 50), F.lit("...' is too long (max 253 chars)."))),
        (literal | _label_lengths(_ascii_form(host)), "max_label_length", "Hostname labels cannot be longer than 63 characters."),
    )


def is_url(c: Column) -> Column:
    return check_url(c)["ok"]


def check_email(c: Column, allowed: tuple[str, ...] = ("localhost",)) -> Column:
    user, domain = F.regexp_extract(c, r"(?s)^(.*)@", 1), F.regexp_extract(c, r"@([^@]*)\z", 1)
    literal = F.regexp_extract(domain, r"(?i)^\[([a-f0-9:.%]+)\]$", 1)
    good_domain = F.lower(domain).isin(*allowed) | F.when(literal != "", is_ipv4(literal) | _maybe_ipv6(literal)).otherwise(check_domain(domain)["ok"])
    return _first_failure(
        (c.isNotNull() & (c != ""), "invalid_email", "Enter a valid email address."),
        (F.contains(c, F.lit("@")), "missing_at", "Email address must contain an '@' symbol."),
        (F.length(c) <= 320, "max_length", F.concat(F.lit("Ensure this email address has at most 320 characters (it has "), F.length(c), F.lit(")."))),
        (user != "", "empty_user", "Email address user part cannot be empty."),
        (~user.rlike(r"[()<>\[\]:,;\\ ]") | (user.startswith('"') & user.endswith('"')), "invalid_user_chars", "Invalid characters in user part of email address."),
        ((domain != "") & good_domain, "invalid_domain", "Invalid domain part in email address."),
    )


def is_email(c: Column) -> Column:
    return check_email(c)["ok"]


def _limit(holds: Column, limit, code: str, text: str) -> Column:
    return _first_failure((holds, code, F.concat(F.lit(text), (limit if isinstance(limit, Column) else F.lit(str(limit))).cast("string"), F.lit("."))))


def check_max_value(c: Column, limit) -> Column:
    return _limit(c <= limit, limit, "max_value", "Ensure this value is less than or equal to ")


def check_min_value(c: Column, limit) -> Column:
    return _limit(c >= limit, limit, "min_value", "Ensure this value is greater than or equal to ")


def _size(c: Column, of: Column | None) -> Column:
    return of if of is not None else F.length(c)


def check_max_length(c: Column, limit: int, size: Column | None = None) -> Column:
    """size: F.size of an array; else the text's length."""
    n = _size(c, size)
    return _first_failure((n <= limit, "max_length", F.concat(F.lit(f"Ensure this value has at most {limit} characters (it has "), n, F.lit(")."))))


def check_min_length(c: Column, limit: int, size: Column | None = None) -> Column:
    n = _size(c, size)
    return _first_failure((n >= limit, "min_length", F.concat(F.lit(f"Ensure this value has at least {limit} characters (it has "), n, F.lit(")."))))


def check_step(c: Column, step: str, offset: str = "0") -> Column:
    """Multiples of step from offset, within 1e-9; a step of 0 fails with invalid_step."""
    kind = "decimal(28,10)"
    value, s = c.cast("string").try_cast(kind), F.lit(step).cast(kind)
    r = F.when(s != 0, (value - F.lit(offset).cast(kind)) % F.when(s != 0, s))
    near = (F.abs(r) <= 1e-9) | (F.abs(r - s) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(s).cast("double"), F.abs(r).cast("double")))
    text = f"Ensure this value is a multiple of step size {step}" + (f", starting from {offset}." if offset != "0" else ".")
    return _first_failure((value.isNotNull(), "invalid_type", "Value must be a number for step validation."), (s != 0, "invalid_step", f"Invalid step value ({step})."), (near, "step_size", text))


def check_decimal(c: Column, max_digits: int | None, decimal_places: int | None) -> Column:
    """Digits of a number's text as written: trailing zeros count, an exponent moves the point."""
    ok = c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z")
    body = F.regexp_replace(F.regexp_extract(c, r"^\s*[+-]?([\d.]+)", 1), r"^0+(?=\d)", "")
    exponent = F.coalesce(F.regexp_extract(c, r"[eE]([+-]?\d+)", 1).try_cast("int"), F.lit(0)) - F.length(F.regexp_extract(body, r"\.(\d*)", 1))
    stored = F.length(F.regexp_replace(F.translate(body, ".", ""), r"^0+(?=\d)", ""))
    decimals = F.greatest(-exponent, F.lit(0))
    digits = F.when(exponent >= 0, stored + exponent).otherwise(F.greatest(stored, decimals))
    whole = F.when(exponent >= 0, stored + exponent).otherwise(F.greatest(stored - decimals, F.lit(0)))
    rules = [(~F.coalesce(c.rlike(r"(?i)^\s*[+-]?(nan|inf(inity)?)\s*\z"), F.lit(False)), "invalid_decimal_nan_inf", "Enter a number."), (ok, "invalid_decimal", "Enter a number.")]
    if max_digits is not None:
        rules.append((digits <= max_digits, "max_digits", f"Ensure that there are no more than {max_digits} digits in total."))
    if decimal_places is not None:
        rules.append((decimals <= decimal_places, "max_decimal_places", f"Ensure that there are no more than {decimal_places} decimal places."))
    if max_digits is not None and decimal_places is not None:
        most = max_digits - decimal_places
        rules.append((whole <= most, "max_whole_digits", f"Ensure that there are no more than {most} digits before the decimal point."))
    return _first_failure(*rules)


def suffix(name: Column) -> Column:
    """The last suffix of a file's name, small, without its point; names that begin with their only point have none."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(base, r"[^/]\.([^./]+)$", 1))


#: Extensions of images.
IMAGES = ("apng", "avif", "bmp", "dib", "eps", "gif", "icns", "ico", "j2k", "jfif", "jp2", "jpe", "jpeg", "jpg", "pbm", "pcx", "pgm", "png", "pnm", "ppm", "ps", "psd", "tga", "tif", "tiff", "webp", "xbm", "xpm")


def check_extension(name: Column, allowed: tuple[str, ...] | None, code: str = "invalid_extension") -> Column:
    known = sorted({x.lower().lstrip(".") for x in allowed}) if allowed is not None else None
    ext = suffix(name)
    shown = F.when(ext == "", F.lit("''")).otherwise(ext)
    message = F.concat(F.lit("File extension '"), shown, F.lit(f"' is not allowed. Allowed extensions are: {', '.join(known or ())}."))
    return _first_failure((name != "", "empty_filename", "Filename cannot be empty."), (ext.isin(*known) if known is not None else F.lit(True), code, message))


def check_image_extension(name: Column) -> Column:
    return check_extension(name, IMAGES, "invalid_image_extension")


def check_no_nul(c: Column) -> Column:
    return _first_failure((~F.contains(F.coalesce(c, F.lit("")), F.lit("\u0000")), "null_characters_not_allowed", "Null characters are not allowed."))
