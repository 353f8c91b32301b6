"""Column functions over texts, ids, times and hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rendering import BILLING_HEADER



@dataclass(frozen=True)
class OutcomeRules:
    """By what the outcome of a result is read: so much of its start, markers so near it, and words of its JSON fields."""

    # fixed values
    head_characters: int = 4000
    marker_characters: int = 600
    denial_markers: tuple[str, ...] = ("The user denied this operation", "user denied", "User declined", "The user doesn't want to proceed")
    timeout_markers: tuple[str, ...] = ("did not complete in", "was sent to the background", "Command timed out", "timed out after")
    failure_markers: tuple[str, ...] = ("The tool execution failed", "<tool_use_error>", "Error executing ", "Search failed", "Command failed", "tool execution was interrupted")
    empty_error_values: tuple[str, ...] = ("", "null", "none")
    success_statuses: tuple[str, ...] = ("success", "approved", "ok")


# fixed values
SHINGLE_WORDS, SHINGLED = 8, 8000
BLOCK = 16
IPV4 = r"(?<![\d.])\d{1,3}(\.\d{1,3}){3}(?![\d.])"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not pasted into what uses it, as a column's expression is.

    The value is the start of a fold over nothing, which gives it to the body as it is. As the one element of a transformed array it would be
    copied, and to take the result out again, Spark derives the type of the whole body for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, x: a, body)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \n\t]+"), lambda w: w != "")


def shingles(text: Column, digest=F.md5, characters: int | None = SHINGLED) -> Column:
    """Hashed 8-word phrases of a text; 1 to 7 words are one phrase. Lineage links by the first 8 000 characters; with
    characters=None the whole text counts."""

    def of(w: Column) -> Column:
        phrase = lambda i: digest(F.array_join(F.slice(w, i, SHINGLE_WORDS), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE_WORDS + 1, F.lit(1))), phrase)))

    return let(words(text if characters is None else F.substring(text, 1, characters)), of)


def without_billing_header(text: Column) -> Column:
    """A text without a leading accounting line."""
    return F.regexp_replace(text, BILLING_HEADER, "")


def normalise(text: Column) -> Column:
    """Without a leading accounting line, white space as single blanks, in lower case."""
    return F.lower(F.btrim(F.regexp_replace(without_billing_header(text), r"(?U)\s+", " ")))


def _key(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^A-Za-z0-9]", "")


def own_keys(raw: Column) -> Column:
    """Keys of an id as written: without punctuation, and that without a leading toolu."""
    keys = F.array_distinct(F.array(_key(raw), F.regexp_replace(_key(raw), "^toolu", "")))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.filter(keys, lambda k: k != ""))


def emitted_keys(raw: Column) -> Column:
    """Keys of an id the model emitted: without punctuation, and without _<digits> after 12 characters or more."""
    cut = F.regexp_extract(raw, r"^([\s\S]{12,}?)_\d+$", 1)
    keys = F.array_distinct(F.array(_key(raw), _key(F.when(cut != "", cut).otherwise(raw))))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(F.filter(keys, lambda k: k != ""))


def replayed_keys(raw: Column) -> Column:
    """Emitted keys, and each without a leading toolu."""
    e = emitted_keys(raw)
    more = F.transform(F.filter(e, lambda k: k.startswith("toolu")), lambda k: F.regexp_replace(k, "^toolu", ""))
    return F.filter(F.array_distinct(F.concat(e, more)), lambda k: k != "")


def holds_ip(text: Column) -> Column:
    v6 = F.exists(F.regexp_extract_all(text, F.lit(r"([0-9A-Fa-f:]{3,})"), 1), lambda c: (F.length(F.regexp_replace(c, "[^:]", "")) >= 2) & c.rlike("[0-9]"))
    return text.rlike(IPV4) | F.coalesce(v6, F.lit(False))


def _ltrim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s]+", "")


def outcome(text: Column, is_error: Column, rules: OutcomeRules = OutcomeRules()) -> Column:
    """Outcome of a tool result: flag, JSON fields, return code, markers near the start, exit code, first line."""
    head = _ltrim(F.substring(text, 1, rules.head_characters))
    near = F.substring(head, 1, rules.marker_characters)
    js = F.when(head.startswith("{"), F.try_parse_json(head))
    get = lambda p, t: F.try_variant_get(js, p, t)
    status = F.lower(F.coalesce(get("$.status", "string"), F.lit("")))
    integer = lambda p: F.when(F.schema_of_variant(F.try_variant_get(js, p, "variant")) == "BIGINT", get(p, "bigint"))
    has_exit = F.try_variant_get(js, "$.exit_code", "variant").isNotNull()
    code = F.when(has_exit, integer("$.exit_code")).otherwise(integer("$.returncode"))
    boolean = lambda p: F.when(F.schema_of_variant(F.try_variant_get(js, p, "variant")) == "BOOLEAN", get(p, "boolean"))
    held = F.try_variant_get(js, "$.error", "variant")
    error = F.when(held.isNotNull() & ~F.is_variant_null(held), F.when(F.schema_of_variant(held) == "STRING", get("$.error", "string")).otherwise("an object"))
    stated = (
        F.when(js.isNull(), None).when(status == "denied", "denied").when(status == "error", "error").when(code == 0, "ok").when(code.isNotNull(), "error")
        .when(~boolean("$.success"), "error").when(boolean("$.success"), "ok").when(error.isNotNull() & ~F.lower(F.trim(error)).isin(*rules.empty_error_values), "error").when(status.isin(*rules.success_statuses), "ok")
    )
    returned = F.coalesce(F.nullif(F.regexp_extract(head, r"^\s*<returncode>(-?\d+)</returncode>", 1), F.lit("")), F.nullif(F.regexp_extract(head, r'^\s*\{[^{}]{0,200}"returncode"\s*:\s*(-?\d+)', 1), F.lit("")))
    marked = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(near, m)) if marks else F.lit(False)
    exit_code = F.nullif(F.regexp_extract(near, r"[Ee]xit [Cc]ode:?\s*(-?\d+)", 1), F.lit(""))
    verdict = lambda n: F.when(n.cast("decimal(38,0)") == 0, "ok").otherwise("error")
    return (
        F.when(F.coalesce(is_error, F.lit(False)), "error").when(stated.isNotNull(), stated).when(returned.isNotNull(), verdict(returned))
        .when(marked(rules.denial_markers), "denied").when(marked(rules.timeout_markers), "timeout").when(marked(rules.failure_markers), "error").when(exit_code.isNotNull(), verdict(exit_code))
        .when(is_error.isNotNull(), "ok").when(F.substring_index(head, "\n", 1).rlike(r"^\s*(?:error|ERROR|Error)\b[:\s]"), "error").otherwise("ok")
    )


def completion_ms(stamp: Column) -> Column:
    """Strict timestamp text to epoch milliseconds: the fraction is cut, no offset means UTC, anything invalid is null."""
    ok = stamp.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$")
    part = lambda a, n: F.substring(stamp, a, n).try_cast("int")
    day = F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd")
    h, m, s = part(12, 2), part(15, 2), part(18, 2)
    fraction = F.rpad(F.regexp_extract(stamp, r"\.(\d+)", 1), 3, "0")
    sign, oh, om = (F.regexp_extract(stamp, r"([+-])(\d{2}):(\d{2})$", k) for k in (1, 2, 3))
    off = F.when(sign == "", 0).otherwise(F.when(sign == "-", -1).otherwise(1) * (oh.try_cast("int") * 3600 + om.try_cast("int") * 60))
    valid = ok & day.isNotNull() & (h <= 23) & (m <= 59) & (s <= 59) & ((sign == "") | ((oh.try_cast("int") <= 23) & (om.try_cast("int") <= 59)))
    return F.when(valid, (F.unix_date(day).cast("long") * 86400 + h * 3600 + m * 60 + s - off) * 1000 + F.substring(fraction, 1, 3).try_cast("int"))


def week_of(day: Column) -> Column:
    """Sunday on or before a date."""
    return F.date_sub(F.next_day(day, "SUN"), 7)


def week_name(sunday: Column) -> Column:
    return F.concat_ws("_", sunday.cast("string"), F.date_add(sunday, 6).cast("string"))


def chained_blocks(tokens: Column, salt: str = "") -> Column:
    """Chained digests of full 16-token blocks: equal up to a block exactly when all tokens up to its end are."""

    def of(t: Column) -> Column:
        n = F.floor(F.size(t) / BLOCK).cast("int")
        block = lambda i: F.array_join(F.slice(t, i * BLOCK + 1, BLOCK), " ")
        start = F.struct(F.lit(salt).alias("last"), F.array().cast("array<string>").alias("out"))

        def step(a, i):
            h = F.md5(F.concat(a["last"], block(i)))
            return F.struct(h.alias("last"), F.array_append(a["out"], h).alias("out"))

        return F.when(n <= 0, F.array().cast("array<string>")).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda a: a["out"]))

    return let(tokens, of)


def pseudonym(raw: Column, kind: str, salt: str, size: int) -> Column:
    """Keyed pseudonym of an id, so many hex digits; null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt), F.lit(f"{kind}:"), raw), 256), 1, size)


def finish_reason(stated: Column) -> Column:
    # fixed values
    table = {"stop": "stop", "end_turn": "stop", "stop_sequence": "stop", "length": "length", "max_tokens": "length", "tool_calls": "tool_calls", "function_call": "tool_calls", "tool_use": "tool_calls", "content_filter": "content_filter", "refusal": "content_filter"}
    return F.when(stated.isNotNull(), F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[stated], F.lit("other")))
