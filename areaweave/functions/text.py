"""Text expressions: lookup keys, slugs, titles, notes, messages, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaweave.settings import COUNTRY, TOKEN_PATTERN

_BLANKS = " \t\n\r\x0b\x0c"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def lookup_key(lga: Column, state: Column) -> Column:
    """"lga, state, country"; the state is left out when null or empty."""
    return F.concat_ws(", ", lga, F.nullif(state, F.lit("")), F.lit(COUNTRY))


def lga_id(lga: Column, state: Column) -> Column:
    """Stable id of a requested area; unlike the slug it also covers the state."""
    return F.md5(F.lower(F.concat(trimmed(lga), F.lit("|"), F.coalesce(trimmed(state), F.lit("")))))


def slug(name: Column) -> Column:
    return F.lower(F.replace(trimmed(name), F.lit(" "), F.lit("_")))


def output_label(name: Column) -> Column:
    return F.concat(F.lit("output/"), slug(name))


def title(layer: Column) -> Column:
    return F.initcap(F.replace(layer, F.lit("_"), F.lit(" ")))


def name_notes(display_name: Column, lga: Column, state: Column) -> Column:
    """Soft notes, joined by "; ", when the display name misses what was asked for.

    Only the first word of the area name is looked for, but the whole state name.
    A null display name gives no note.
    """
    shown = F.lower(display_name)
    first_word = F.lower(F.element_at(F.split(trimmed(lga), r"\s+"), 1))

    def note(missing: Column, kind: str, name: Column) -> Column:
        text = F.concat(
            F.lit(f"The boundary's display name does not mention the {kind} '"),
            name,
            F.lit("'; check it by hand."),
        )
        return F.when(missing, text)

    notes = F.array(
        note(~F.contains(shown, first_word), "requested area", lga),
        note(~F.contains(shown, F.lower(F.nullif(state, F.lit("")))), "requested state", state),
    )
    return F.nullif(F.array_join(notes, "; "), F.lit(""))


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, TOKEN_PATTERN, "")


def holds_token(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(TOKEN_PATTERN)), F.lit(False))
