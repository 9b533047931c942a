"""Strict parsing of structured replies.

A reply is accepted only if it is one JSON object with every required field, of
the right types throughout and without null elements. Other keys are ignored;
of equal keys the last holds where the session sets
spark.sql.variant.allowDuplicateKeys, as ours does, and else the reply fails;
space around is allowed, a trailing comma is not.
The check runs in the JVM: `from_json` in its strict mode would coerce numbers
to strings, so the parsed variant's own schema is compared first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ELEMENT, SENTIMENT

#: What Spark says of a JSON list of strings or an empty one; a list of nulls has the second too.
_STRINGS, _EMPTY = "ARRAY<STRING>", "ARRAY<VOID>"


def _parsed(reply: Column) -> Column:
    return F.try_parse_json(reply)


def _schema(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def strings_ok(v: Column, path: str) -> Column:
    """A list of strings, none of them null."""
    values = _get(v, path, "array<string>")
    return F.coalesce(_schema(v, path).isin(_STRINGS, _EMPTY) & ~F.exists(values, lambda x: x.isNull()), F.lit(False))


def pairs_ok(v: Column, path: str) -> Column:
    """A list of objects, each with an element and an affect that are strings."""
    elements = _get(v, path, "array<variant>")
    text = lambda e, k: F.coalesce(F.schema_of_variant(F.try_variant_get(e, f"$.{k}", "variant")) == "STRING", F.lit(False))
    return F.coalesce(F.startswith(_schema(v, path), F.lit("ARRAY<")) & F.forall(elements, lambda e: text(e, "populism_element") & text(e, "populism_affect")), F.lit(False))


def _result(ok: Column, value: Column) -> Column:
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, F.lit("reply does not fit its schema")).alias("error"))


def parse_sentiment(reply: Column) -> Column:
    """struct<ok, value: struct of five lists of strings, error>."""
    v = _parsed(reply)
    ok = F.coalesce(v.isNotNull(), F.lit(False))
    for name in SENTIMENT:
        ok = ok & strings_ok(v, f"$.{name}")
    return _result(ok, F.struct(*(_get(v, f"$.{name}", "array<string>").alias(name) for name in SENTIMENT)))


def parse_formula(reply: Column) -> Column:
    """struct<ok, value: struct<populism_analysis, populism_us, populism_frontier>, error>."""
    v = _parsed(reply)
    ok = F.coalesce(v.isNotNull() & (_schema(v, "$.populism_analysis") == "STRING"), F.lit(False)) & pairs_ok(v, "$.populism_us") & pairs_ok(v, "$.populism_frontier")
    kind = f"array<{ELEMENT}>"
    value = F.struct(_get(v, "$.populism_analysis", "string").alias("populism_analysis"), _get(v, "$.populism_us", kind).alias("populism_us"), _get(v, "$.populism_frontier", kind).alias("populism_frontier"))
    return _result(ok, value)

