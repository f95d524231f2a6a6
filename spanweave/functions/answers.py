"""Answers of unknown shape: JSON bodies whose parts are strings, objects or lists, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is shown for an answer without a text, a failed one, and a body that is no JSON.
NO_SUMMARY, FAILED, UNREACHABLE = "Summary unavailable.", "Failed to generate summary for this node.", "Unable to reach summarization service. Please try again."


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _string(v: Column) -> Column:
    """The value if it is a string, else null."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _shown(v: Column) -> Column:
    """Any value as text: strings as they are, others as JSON."""
    return F.coalesce(_string(v), F.to_json(v))


def _truthy(v: Column) -> Column:
    """Whether a value counts as true: not missing, null, false, zero or an empty string."""
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(F.when(kind == "VOID", False).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(kind == "STRING", _string(v) != "").when(kind.isin("OBJECT", "ARRAY"), True).otherwise(number != 0), F.lit(False))


def _items(v: Column) -> Column:
    """The items of a list as texts; null if the value is no list."""
    return F.when(_kind(v) == "ARRAY", F.transform(F.try_variant_get(v, "$", "array<variant>"), _shown))


def answer_parts(body: Column, ok: Column | None = None) -> Column:
    """struct(purpose string, details array<string>, calls array<string>) of a body {success, explanation, error}.

    The explanation is a text, or an object with a text in explanation or purpose, a list in steps or else in
    details, and a list in calls; the first that has the right type counts, and a list's items are texts as they are,
    others as JSON. A body whose success isn't true in the loose sense, or whose response failed (ok), gives its error.
    A body that is null or no JSON gives a fixed text. Lists that are missing are empty.
    """
    v = F.try_parse_json(body)
    part = lambda path: F.try_variant_get(v, path, "variant")
    none = F.array().cast("array<string>")
    purpose = F.coalesce(_string(part("$.explanation")), _string(part("$.explanation.explanation")), _string(part("$.explanation.purpose")), F.lit(NO_SUMMARY))
    error = F.when(_truthy(part("$.error")), _shown(part("$.error"))).otherwise(FAILED)
    good = _truthy(part("$.success")) & (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False)))
    lists = {"details": F.coalesce(_items(part("$.explanation.steps")), _items(part("$.explanation.details")), none), "calls": F.coalesce(_items(part("$.explanation.calls")), none)}
    return F.struct(
        F.when(v.isNull(), UNREACHABLE).when(good, purpose).otherwise(error).alias("purpose"),
        *[F.when(v.isNotNull() & good, c).otherwise(none).alias(name) for name, c in lists.items()],
    )


def relative_line(line: Column, start: Column) -> Column:
    """A line's number in a snippet that starts at line start, from 1; at least 1."""
    return F.greatest(F.lit(1), line - start + 1)
