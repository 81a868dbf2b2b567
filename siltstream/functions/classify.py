"""Classifiers, keys and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MYSQL_TRANSIENT = (1205, 1213, 1290, 1317, 1062, 1045, 1044, 1142)
SQLSTATE_TRANSIENT = ("40P01", "55P03", "57014", "57P01", "57P02", "57P03", "23505")
HEALTHY_STATUSES = (401, 403, 405, 501)
CREDENTIAL_KEYS = ("password", "passwd", "pwd", "token", "access_token", "secret", "api_key", "apikey", "sig", "signature")
NO_CLIENT_CERT = ("NoCertificatesPresented", "peer sent no certificates", "CertificateRequired", "certificate required")
BAD_CERT = (
    "InvalidCertificate",
    "UnknownIssuer",
    "UnknownCA",
    "unknown ca",
    "BadCertificate",
    "bad certificate",
    "DecryptError",
    "decrypt error",
    "Expired",
    "expired",
    "BadEncoding",
    "NotValidForName",
)
EXHAUSTION = ("EMFILE", "ENFILE", "ENOBUFS", "ENOMEM")
TIERS = ("sync", "batched", "buffered")
RECOVERABLE = ("payload_too_large_local", "no_default_durability", "empty_payload_local", "nack_internal_error")


def http_class(status: Column) -> Column:
    """ok for 2xx; transient for 408, 429 and 5xx; permanent for the rest."""
    return F.when(status.between(200, 299), "ok").when(status.isin(408, 429) | status.between(500, 599), "transient").otherwise("permanent")


def mysql_class(code: Column) -> Column:
    return F.when(code.isin(*MYSQL_TRANSIENT), "transient").otherwise("permanent")


def sqlstate_class(state: Column) -> Column:
    """An error without a SQLSTATE (a lost connection) is transient."""
    return F.when(state.isNull() | state.isin(*SQLSTATE_TRANSIENT), "transient").otherwise("permanent")


def health_class(status: Column) -> Column:
    """Health from the probe's status; null stands for a timeout."""
    healthy = status.between(200, 399) | status.isin(*HEALTHY_STATUSES)
    return F.when(healthy, "healthy").when(status.between(400, 499), "degraded").otherwise("down")


def tls_failure_class(message: Column) -> Column:
    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | message.contains(w)
        return out

    return F.when(has(NO_CLIENT_CERT), "no_client_cert").when(has(BAD_CERT), "bad_cert").otherwise("other")


def client_recoverable(error: Column) -> Column:
    return error.isin(*RECOVERABLE)


def connection_fate(event: Column) -> Column:
    """open after an ack, a transient nack or a health check; closed after anything else."""
    return F.when(event.isin("ack", "internal_error", "health_check"), "open").otherwise("closed")


def tier_parse(text: Column) -> Column:
    """The tier, in any case of letters; null for an unknown one."""
    return F.when(F.lower(text).isin(*TIERS), F.lower(text))


def ack_point(tier: Column) -> Column:
    """When a record of this tier is acknowledged."""
    return F.when(tier.isin("sync", "batched"), "after_group_sync").when(tier == "buffered", "after_write")


def is_identifier(name: Column, longest: int) -> Column:
    return name.rlike(rf"\A[A-Za-z_][A-Za-z0-9_]{{0,{longest - 1}}}\z")


def insert_text(table: str, column: str, rows: Column, style: str, ignore: bool = False) -> Column:
    """Multi-row INSERT with ``?`` (mysql) or ``$n`` (postgres) placeholders."""
    numbers = F.sequence(F.lit(1), rows.cast("int"))
    if style == "mysql":
        marks = F.array_join(F.transform(numbers, lambda _: F.lit("(?)")), ",")
        return F.concat(F.lit(f"INSERT {'IGNORE ' if ignore else ''}INTO `{table}` (`{column}`) VALUES "), marks)
    marks = F.array_join(F.transform(numbers, lambda i: F.concat(F.lit("($"), i.cast("string"), F.lit(")"))), ",")
    return F.concat(F.lit(f'INSERT INTO "{table}" ("{column}") VALUES '), marks, F.lit(" ON CONFLICT DO NOTHING" if ignore else ""))


def idempotency_key(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


def has_newline(payload: Column) -> Column:
    """Whether a record can't be framed as a line; looks at bytes, so it holds for any encoding."""
    return F.contains(payload, F.lit(b"\n")) | F.contains(payload, F.lit(b"\r"))


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header: a whole number from 1 to 3600, else null."""
    seconds = F.trim(value).try_cast("bigint")
    return F.when(F.trim(value).rlike(r"\A\+?[0-9]+\z") & seconds.between(1, 3600), seconds)


def redact_query(text: Column) -> Column:
    """Values of credential parameters in ``head?query#fragment`` become ``<redacted>``."""
    keys = "|".join(CREDENTIAL_KEYS)
    head = F.regexp_extract(text, r"\A([^?]*)", 1)
    query = F.regexp_extract(text, r"\A[^?]*\?([^#]*)", 1)
    rest = F.regexp_extract(text, r"\A[^?]*\?[^#]*((?s:.*))\z", 1)
    pairs = F.transform(F.split(query, "&"), lambda p: F.regexp_replace(p, rf"(?is)\A({keys})=.*\z", "$1=<redacted>"))
    return F.when(text.contains("?"), F.concat(head, F.lit("?"), F.array_join(pairs, "&"), rest)).otherwise(text)


def redact_url(url: Column) -> Column:
    """Password in the authority (after its first colon, up to the last @) and credential parameters redacted."""
    scheme = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(scheme) + 4, F.length(url))
    authority = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    after = F.substring(rest, F.length(authority) + 1, F.length(rest))
    hidden = F.regexp_replace(authority, r"(?s)\A([^:@]*(?:@[^:@]*)*):.*@([^@]*)\z", "$1:<redacted>@$2")
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), hidden, redact_query(after))).otherwise(redact_query(url))


def sanitize_excerpt(text: Column, longest: int) -> Column:
    """Control characters as dots, cut to so many characters: safe to log."""
    return F.substring(F.regexp_replace(text, r"\p{Cc}", "."), 1, longest)


def percent_decode(text: Column) -> Column:
    """%XX decoded, invalid escapes verbatim; the bytes are read as UTF-8 with replacement."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|%|[^%]+)"), 1)
    raw = F.transform(parts, lambda p: F.when(p.rlike(r"\A%[0-9A-Fa-f]{2}\z"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "utf-8"))))
    return F.make_valid_utf8(F.unhex(F.array_join(raw, "")).cast("string"))


def split_credentials(url: Column) -> Column:
    """struct(url without userinfo, user, password), both decoded; null user and password without userinfo."""
    pattern = r"(?s)\A([^:/?#]*://)([^/?#]*)@([^/?#@]*)(.*)\z"
    info = F.regexp_extract(url, pattern, 2)
    bare = F.concat(F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 3), F.regexp_extract(url, pattern, 4))
    has = url.rlike(pattern)
    user = percent_decode(F.substring_index(info, ":", 1))
    word = F.when(info.contains(":"), percent_decode(F.substring(info, F.instr(info, ":") + 1, F.length(info))))
    return F.struct(F.when(has, bare).otherwise(url).alias("url"), F.when(has, user).alias("user"), F.when(has, word).alias("password"))


def recommended_agents(cores: Column) -> Column:
    return F.floor(F.greatest(cores - 2, F.lit(2)) / 2).cast("long")


def agent_advice(cores: Column, shards: Column, workers: Column) -> Column:
    """warn: far more agents than cores support; info: far fewer; null cores or 0: no advice."""
    best, actual = recommended_agents(cores), F.greatest(shards, workers)
    return F.when(cores > 0, F.when(actual > 2 * best, "warn").when((best >= 4) & (4 * actual < best), "info"))


def path_check(path: Column) -> Column:
    """ok, or the first reason against a path: not absolute, parent component, null byte."""
    return (
        F.when(~path.startswith("/"), "not_absolute")
        .when(path.rlike(r"(?:\A|/)\.\.(?:/|\z)"), "parent_component")
        .when(path.contains("\0"), "null_byte")
        .otherwise("ok")
    )


def one_decimal(x: Column) -> Column:
    """A double of at least 1 with one decimal, rounded by its exact binary value, ties to the even digit.

    ``format_string`` rounds the shortest decimal text and ties up.
    """
    whole, bits = F.floor(x), 52
    scaled = ((x - whole) * F.lit(float(1 << bits))).cast("long") * 10
    tenths, rest = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1))
    half = F.lit(1 << (bits - 1))
    up = ((rest > half) | ((rest == half) & (tenths % 2 == 1))).cast("long")
    total = whole * 10 + tenths + up
    return F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string"))


def fmt_bytes(n: Column) -> Column:
    """Bytes in units of 1024, one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = F.when(n >= 1024**power, F.concat(one_decimal(n / F.lit(float(1024**power))), F.lit(f" {unit}"))).otherwise(out)
    return out


def fmt_micros(us: Column) -> Column:
    """Microseconds as s, ms or whole µs."""
    sign = F.when((us < 0) & (us >= -0.5), "-").otherwise("")  # -0, as of every rounded double
    small = F.concat(sign, F.rint(us).cast("long").cast("string"), F.lit(" µs"))
    return F.when(us >= 1e6, F.concat(one_decimal(us / 1e6), F.lit(" s"))).when(us >= 1e3, F.concat(one_decimal(us / 1e3), F.lit(" ms"))).otherwise(small)
