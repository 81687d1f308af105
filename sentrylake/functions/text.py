"""Column functions on log text: times, decoding, payloads, clipping, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentrylake import config as C


def any_of(c: Column, needles: Sequence[str]) -> Column:
    """Whether the text contains one of the needles."""
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def first_of(c: Column, needles: Sequence[str]) -> Column:
    """The first needle, in list order, that the text contains; null if none."""
    out = None
    for n in needles:
        out = F.when(c.contains(n), n) if out is None else out.when(c.contains(n), n)
    return out


def filled(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def syslog_time(c: Column, year: int) -> Column:
    """A year-less syslog time in UTC; null if malformed."""
    text = F.concat(F.lit(f"{year} "), F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(" +0000"))
    return F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss Z"))


def access_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def iso_time(c: Column, fallback: Column | None = None) -> Column:
    """An ISO-8601 time; without a zone it is UTC."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("+00:00")))
    out = zoned.try_cast("timestamp")
    return out if fallback is None else F.coalesce(out, fallback)


def percent_decoded(c: Column) -> Column:
    """Percent-decoding that keeps ``+`` and stray ``%``."""
    safe = F.replace(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), c)


def web_payload(path: Column, agent: Column) -> Column:
    """T1190 for an attack in agent or path, T1595.002 for a scanner's agent, else null."""
    decoded = F.lower(percent_decoded(F.coalesce(path, F.lit(""))))
    ua = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(ua.contains(C.JNDI) | any_of(decoded, C.SHAPING_PAYLOADS), "T1190").when(any_of(ua, C.SCANNERS), "T1595.002")


def login_like(path: Column) -> Column:
    return F.lower(F.coalesce(path, F.lit(""))).rlike("|".join(C.LOGIN_WORDS))


def clean_technique(c: Column) -> Column:
    """Upper-case and trimmed; words for nothing become null."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*C.NO_TECHNIQUE), F.upper(t))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clipped(c: Column, limit: int) -> Column:
    """White space squeezed, then cut to `limit` characters with an ellipsis."""
    t = squeezed(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…")))


def first_sentence(c: Column, limit: int = 200) -> Column:
    t = squeezed(c)
    return clipped(F.coalesce(filled(F.regexp_extract(t, r"^(.+?[.!?])(\s|$)", 1)), t), limit)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def model_key(provider: Column, model: Column) -> Column:
    return F.concat_ws("__", slug(provider), slug(model))


def run_key(provider: Column, model: Column, version: Column) -> Column:
    return F.concat_ws("__", model_key(provider, model), F.when(version.startswith("v"), version).otherwise(F.concat(F.lit("v"), version)))


def raw_snippet(raw: Column, most: int = 2, limit: int = 160) -> Column:
    """Up to `most` readable lines of a unit's raw record."""
    rest = F.to_json(raw.dropFields("source"))
    lines = (
        F.when(raw["sample_lines"].isNotNull(), raw["sample_lines"])
        .when(raw["line"].isNotNull(), F.array(raw["line"]))
        .when(raw["event"].isNotNull(), F.array(F.to_json(raw["event"])))
        .when(F.size(raw["events"]) > 0, F.array(F.to_json(F.get(raw["events"], F.lit(0)))))
        .otherwise(F.array(rest))
    )
    return F.transform(F.slice(lines, 1, most), lambda x: clipped(x, limit))


def confidence_by_count(count: Column, low: float, mid: float, high: float) -> Column:
    return F.when(count >= 100, high).when(count >= 30, mid).otherwise(low)


# Fields of the evidence block, in order, with the names they appear under.
EVIDENCE = (
    ("count", "count"), ("distinct_users", "targets"), ("status_sequence", "status_sequence"), ("final_status", "final_status"),
    ("user_agents", "user_agents"), ("sample_paths", "sample_paths"), ("path", "path"), ("user_agent", "user_agent"), ("command", "command"),
)
NESTED_EVIDENCE = (
    "event_code", "command_line", "process_name", "new_account", "port", "cidr", "protocol", "policy_name", "change_type", "target_user",
    "failure_reason", "description",
)


def listed(c: Column, most: int = 6) -> Column:
    """A list as text, cut to `most` items with a note of how many more."""
    more = F.concat(F.lit(", ... (+"), (F.size(c) - most).cast("string"), F.lit(" more)"))
    return F.concat(F.array_join(F.slice(c, 1, most), ", "), F.when(F.size(c) > most, more).otherwise(F.lit("")))


def status_sequence(raw: Column) -> Column:
    """All statuses of a login burst in order, from its runs; or the list that the unit holds."""
    spread = F.flatten(F.transform(raw["status_runs"], lambda r: F.array_repeat(r["status"], r["n"].cast("int"))))
    return F.coalesce(raw["status_sequence"], spread)


def listed_runs(runs: Column, most: int = 6) -> Column:
    """As listed() over the statuses of runs, of which no more are spread than are shown."""
    shown = F.slice(F.flatten(F.transform(F.slice(runs, 1, most), lambda r: F.array_repeat(r["status"], F.least(r["n"], F.lit(most)).cast("int")))), 1, most)
    n = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["n"])
    more = F.concat(F.lit(", ... (+"), (n - most).cast("string"), F.lit(" more)"))
    return F.concat(F.array_join(shown, ", "), F.when(n > most, more).otherwise(F.lit("")))


def evidence(u: Column) -> Column:
    """A unit as a block of text; u: a unit struct."""
    raw = u["raw"]
    head = [F.concat(F.lit(f"{k}: "), F.coalesce(u[k].cast("string"), F.lit("unknown"))) for k in ("source", "action", "actor", "target", "status")]
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    head.append(F.when(raw["window_start"].isNotNull() & raw["window_end"].isNotNull(), F.concat(F.lit("window: "), stamp(raw["window_start"]), F.lit(" .. "), stamp(raw["window_end"]))))
    for key, name in EVIDENCE:
        if key in ("distinct_users", "status_sequence", "user_agents", "sample_paths"):
            values = F.when(F.size(raw[key]) > 0, raw[key])
            if key == "distinct_users":
                values = F.coalesce(values, F.when(F.size(raw["distinct_targets"]) > 0, raw["distinct_targets"]))
            text = listed(values)
            if key == "status_sequence":
                text = F.coalesce(text, listed_runs(F.when(F.size(raw["status_runs"]) > 0, raw["status_runs"])))
            head.append(F.concat(F.lit(f"{name}: "), text))
        else:
            head.append(F.concat(F.lit(f"{name}: "), filled(raw[key].cast("string"))))
    head += [F.concat(F.lit(f"{k}: "), filled(raw["event"][k])) for k in NESTED_EVIDENCE]
    samples = F.when(F.size(raw["sample_lines"]) > 0, F.concat(F.lit("sample_lines:\n"), F.array_join(F.transform(raw["sample_lines"], lambda s: F.concat(F.lit("  - "), s)), "\n")))
    head.append(F.coalesce(samples, F.concat(F.lit("sample_line: "), filled(raw["line"]))))
    return F.concat_ws("\n", *head)


def prompt(template: str, block: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{event}"), block) if "{event}" in template else F.concat(F.lit(template + "\n\n"), block)


def response_key(provider: Column, model: Column, version: Column, unit_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", provider, model, version, unit_id, text), 256)
