"""Scalar functions of usage analytics, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.dims import MIN_COST_PER_PERCENT, PLAN_MULTIPLIERS, RATIO_DEVIATION, RESET_JITTER_S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_model(model: Column | str) -> Column:
    """Lower case, after the last slash, without a trailing -YYYY-MM-DD or -YYYYMMDD (some name must stay)."""
    m = F.element_at(F.split(F.lower(F.trim(col(model))), "/"), -1)
    return F.regexp_replace(F.regexp_replace(m, r"(?<=.)-\d{4}-\d{2}-\d{2}$", ""), r"(?<=.)-\d{8}$", "")


def service_tier(tier: Column | str) -> Column:
    return F.when(F.lower(F.trim(col(tier))).isin("fast", "priority"), "fast").otherwise("default")


def normalize_plan(plan: Column | str) -> Column:
    """A plan by what its text holds, the first rule that applies; case does not matter, hyphens and underscores are spaces."""

    def rule(p: Column) -> Column:
        says = lambda *texts: reduce(lambda a, b: a | b, (p.contains(t) for t in texts))
        rules = (("pro_lite", says("5x", "5 x") | (says("pro") & says("lite", "light", "5"))), ("pro", says("20x", "20 x") | (says("pro") & ~says("plus"))), ("plus", says("plus")))
        return F.coalesce(*(F.when(r, name) for name, r in rules), F.lit("unknown"))

    clean = F.trim(F.regexp_replace(F.lower(col(plan)), r"[-_\s]+", " "))
    return F.transform(F.array(clean), rule)[0]  # a list of one, so that the rules read the text and do not each clean it again


def plan_multiplier(plan: Column | str) -> Column:
    out = F.lit(float(PLAN_MULTIPLIERS["unknown"]))
    for name, m in PLAN_MULTIPLIERS.items():
        out = F.when(col(plan) == name, float(m)).otherwise(out)
    return out


def epoch(ts: Column | str) -> Column:
    """Whole seconds of an ISO-8601 string (session time zone where it names none); null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(col(ts)))


def to_number(x: Column | str) -> Column:
    """A finite double, or null."""
    d = col(x).cast("string").try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def first_truthy(*xs: Column | str) -> Column:
    """The first number that is neither null nor 0; 0 if there is none."""
    return F.coalesce(*(F.nullif(col(x), F.lit(0)) for x in xs), F.lit(0))


def first_present(m: Column | str, *keys: str) -> Column:
    """The value of the first key that a map holds, even if it is null."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(col(m), k), F.try_element_at(col(m), F.lit(k))).otherwise(out)
    return out


def or_unknown(x: Column | str, default: str = "unknown") -> Column:
    return F.coalesce(F.nullif(col(x), F.lit("")), F.lit(default))


def reset_moved(before: Column, after: Column, jitter: int = RESET_JITTER_S) -> Column:
    """'forward', 'backward' or 'same' for two epoch times; null if either is null. A null is neither."""
    d = after - before
    return F.when(d > jitter, "forward").when(d < -jitter, "backward").when(d.isNotNull(), "same")


def before_reset(checked: Column, reset: Column, jitter: int = RESET_JITTER_S) -> Column:
    return F.coalesce(checked < reset - jitter, F.lit(False))


def raw_reset_reason(reset_at: Column, reset_after: Column, completed: Column, tolerance: int = 300) -> Column:
    """Null if a reset time and a remaining time agree within the tolerance, else a reason."""
    off = F.abs((reset_at - completed) - reset_after)
    return F.when(off > tolerance, F.format_string("reset time differs by %d s", off.cast("long")))


def arbitration_threshold(window: Column, multiplier: Column) -> Column:
    return F.greatest(F.when(window == "5h", 25.0).otherwise(10.0), 2 * multiplier)


def manual_reset_limit(window: Column, plan: Column) -> Column:
    return F.when((plan == "plus") & (window == "5h"), 5.0).when((plan == "plus") & (window == "7d"), 1.0).when(plan.isin("pro", "pro_lite"), 1.0)


def needs_trusted_baseline(window: Column, plan: Column) -> Column:
    return ((window == "7d") & plan.isin("plus", "pro_lite", "pro")) | ((window == "5h") & plan.isin("pro_lite", "pro"))


def valid_delta(percent: Column, cost: Column) -> Column:
    return (percent > 0) & (cost / F.when(percent > 0, percent) >= MIN_COST_PER_PERCENT)


def ratio(cost: Column, percent: Column) -> Column:
    return F.when(percent > 0, cost / F.when(percent > 0, percent))


def deviation(r: Column, average: Column) -> Column:
    return F.when(average > 0, r / F.when(average > 0, average))


def deviation_warning(dev: Column) -> Column:
    return F.coalesce((dev >= RATIO_DEVIATION) | (dev <= 1 / RATIO_DEVIATION), F.lit(False))


def time_left_percent(reset: Column, now: Column, minutes: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1 - (reset - now) / (minutes * 60)) * 100))


def percent_text(p: Column) -> Column:
    return F.format_string("%.1f%%", p.cast("double"))


def duration_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(d > 0, F.format_string("%dd %dh", d, h)).when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def fingerprint(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(20))


def portable_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~name.rlike(r"[. ]$") & ~name.rlike(r"(?i)^(?:con|prn|aux|nul|com[0-9]|lpt[0-9])(?:\.|$)")


def jwt_payload(token: Column, schema: str) -> Column:
    """The decoded middle part of a token, by schema; nothing is verified."""
    body = F.translate(F.split(token, r"\.")[1], "-_", "+/")
    padded = F.rpad(body, F.ceil(F.length(body) / 4).cast("int") * 4, "=")
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 in hex, for keys of at most 64 bytes."""
    k = F.rpad(F.hex(key), 128, "0")
    xor = lambda b: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(k, 2 * i + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(b))), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(xor(0x36), message), 256))
    return F.sha2(F.concat(xor(0x5C), inner), 256)


def remote_identity(response: Column, login: Column) -> Column:
    """struct<user_id, account_id, email, plan_type> of two maps, the response's values first; null where neither names any."""
    names = ("user_id", "account_id", "email", "plan_type")
    value = lambda n: F.coalesce(F.try_element_at(response, F.lit(n)), F.try_element_at(login, F.lit(n)))
    return F.when(F.coalesce(*map(value, names)).isNotNull(), F.struct(*(value(n).alias(n) for n in names)))


def identity_changed(before: Column, now: Column) -> Column:
    """Whether an identity is known before and now, and differs in any part."""
    return before.isNotNull() & now.isNotNull() & ~before.eqNullSafe(now)


def session_order(ts: str = "updated_ts", session: str = "session_id") -> list[Column]:
    """The order of token sessions: by the time of their last update, those without one first, then by id."""
    return [F.coalesce(F.col(ts), F.lit(0)), F.col(session)]


def significant(x: Column, digits: int) -> Column:
    """A number with so many significant digits, without trailing zeros; with an exponent below 1e-4 or from 10^digits on."""
    v = x.cast("double")
    size = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v))))
    size = size + F.when(F.round(F.abs(v) / F.pow(F.lit(10.0), size), digits - 1) >= 10, 1).otherwise(0)
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = trim(F.format_string(f"%.{digits + 4}f", F.round(v * F.pow(F.lit(10.0), digits - 1 - size), 0) / F.pow(F.lit(10.0), digits - 1 - size)))
    part = trim(F.format_string(f"%.{digits - 1}f", v / F.pow(F.lit(10.0), size)))
    exponent = F.concat(F.when(size < 0, "-").otherwise("+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    return F.when(v.isNull(), "-").when((size < -4) | (size >= digits), F.concat(part, F.lit("e"), exponent)).otherwise(plain)


def event_cost(direct: Column, fallback: Column) -> Column:
    """The cost of a sample's events, else its total cost, else 0; numbers that are not finite are none."""
    return F.coalesce(to_number(direct), to_number(fallback), F.lit(0.0))


def event_cost_by_model(direct: Column, by_model: Column, cost: Column, default: str) -> Column:
    """map<model, cost>: the direct map where it says anything or there is no cost, else the other map, else all to the default."""
    clean = lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & ~F.isnan(v))
    use = direct.isNotNull() & ((F.size(clean(direct)) > 0) | (cost == 0))
    other = F.when(F.size(F.coalesce(clean(by_model), F.create_map().cast("map<string,double>"))) > 0, clean(by_model)).otherwise(F.create_map(F.lit(default), cost))
    return F.when(use, clean(direct)).otherwise(other)
