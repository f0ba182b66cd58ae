"""Text, JSON and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewflow.functions.binding import let

# Outcome when a model reply cannot be read.
DEFAULT_REJECTION = "Hard Rejection"
NO_JSON = "no_json"
BAD_JSON = "bad_json"
# Fixed value: filler for a missing angle.
NO_ANGLE = "No specific angle available"
# Fixed value: shortest text taken for a session id.
SESSION_ID_LENGTH = 8


def email_hash(body: Column, sender: Column) -> Column:
    text = F.concat(F.coalesce(body, F.lit("")), F.lit("|"), F.coalesce(sender, F.lit("")))
    return F.sha2(text, 256)


def clean_text(col: Column) -> Column:
    """Tabs become spaces and carriage returns line feeds; NULL becomes empty."""
    return F.translate(F.coalesce(col, F.lit("")), "\t\r", " \n")


def embed_text(col: Column) -> Column:
    return F.translate(col, "\n", " ")


def render(template: Column, slots: dict[str, Column]) -> Column:
    """Replace each named slot literally."""
    for slot, value in slots.items():
        template = F.replace(template, F.lit(slot), value)
    return template


def samples(threads: Column) -> Column:
    """Sample threads as one text, a blank line between them."""
    return F.array_join(threads, "\n\n")


def angle(angles: Column, n: int) -> Column:
    """The n-th angle (from 0) or the filler text."""
    return F.coalesce(F.get(angles, F.lit(n)), F.lit(NO_ANGLE))


def with_context(prompt: Column, context: Column, limit: int | None = None) -> Column:
    """Append document text under its heading when there is any."""
    body = context if limit is None else F.concat(F.substring(context, 1, limit), F.lit("..."))
    heading = F.lit("\n\nAdditional Client Context from Documents:\n")
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(prompt, heading, body)) \
            .otherwise(prompt)


def json_part(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def _whole_object(part: Column, schema: str) -> Column:
    """The parsed object, NULL unless the text is one whole JSON object and nothing else."""
    listed = F.from_json(F.concat(F.lit("["), part, F.lit("]")), f"ARRAY<{schema}>")
    return let(listed, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def extract_json(text: Column, schema: str) -> Column:
    """Struct of the parsed object and a status: NULL when read, else why it was not."""
    def parse(part):
        return let(_whole_object(part, f"STRUCT<{schema}>"), lambda value: F.struct(
            value.alias("value"),
            F.when(part.isNull(), NO_JSON).when(value.isNull(), BAD_JSON).alias("status")))

    return let(json_part(text), parse)


def rejection_parse(text: Column) -> Column:
    """Rejection type and angles from the object between the last ``{`` and the last ``}``."""
    part = F.regexp_extract(text, r"(\{[^{]*\})[^{}]*\z", 1)
    parsed = _whole_object(part, "STRUCT<rejection_type: STRING, angles: ARRAY<STRING>>")
    return let(parsed, lambda found: F.struct(
        F.coalesce(found["rejection_type"], F.lit(DEFAULT_REJECTION)).alias("rejection_type"),
        F.coalesce(found["angles"], F.array().cast("array<string>")).alias("angles")))


def tagged_body(text: Column, tag: str = "response") -> Column:
    """Trimmed text between the tags when both are there, else the text unchanged."""
    opening, closing = f"<{tag}>", f"</{tag}>"

    def inner(whole):
        start = F.instr(whole, opening) + len(opening)
        body = F.substring(whole, start, F.greatest(F.instr(whole, closing) - start, F.lit(0)))
        return F.when(whole.contains(opening) & whole.contains(closing),
                      F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise(whole)

    return let(text, inner)


def label_from_notice(message: Column) -> Column:
    """Text between the first ``Classification:`` and the end of its line, else ``N/A``."""
    found = F.regexp_extract(message, r"Classification:((?:(?!Classification:)[^\n])*)", 1)
    return F.when(message.contains("Classification:"), label_clean(found)).otherwise(F.lit("N/A"))


def preview(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))) \
            .otherwise(text)


def pretty_name(name: Column) -> Column:
    """Underscores become spaces, each word starts with a capital, the rest stays."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    words = F.split(spaced, r"(?<![A-Za-z0-9])(?=[A-Za-z0-9])")
    capital = lambda w: F.when(
        w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))
    ).otherwise(w)
    return F.array_join(F.transform(words, capital), "")


def session_from_action(action_id: Column, value: Column) -> Column:
    """Session id from the last part of the action id, else from the first long value part."""
    long_enough = lambda part: F.length(part) >= SESSION_ID_LENGTH
    tail = F.element_at(F.split(action_id, "_"), -1)
    parts = F.filter(F.split(value, "_"), long_enough)
    return F.when(action_id.contains("_") & long_enough(tail), tail) \
            .when(value.contains("_"), F.get(parts, F.lit(0)))


def before_underscore(value: Column) -> Column:
    return F.substring_index(value, "_", 1)


def label_clean(label: Column) -> Column:
    return F.regexp_replace(label, r"^\s+|\s+$", "")
