"""Entity functions over nested types (N5, N6 row form, N7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.config import ENTITY_TYPES
from evalspark.functions.text import strip_ws


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _norm_set(arr: Column) -> Column:
    return F.array_distinct(F.transform(arr, lambda e: F.lower(strip_ws(e))))


def parse_entities(response, keys=ENTITY_TYPES) -> Column:
    """Model JSON answer -> flat, lower-cased, distinct entity array over ``keys``.

    Code fences are removed first.  The answer must be one JSON object and nothing more, and
    every value under ``keys`` a list of strings; otherwise all of it counts as empty.  (A bare
    string or an object in place of a list makes that key alone empty.)"""
    clean = strip_ws(F.regexp_replace(_c(response), r"```json|```", ""))
    # as the only element of a list, so that text after the object is an error
    answer = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), clean, F.lit("]"))), "$", "array<variant>")
    parsed = F.get(answer, 0)
    whole = (F.size(answer) == 1) & F.schema_of_variant(parsed).startswith("OBJECT")
    none = F.array().cast("array<variant>")
    values = [F.try_variant_get(parsed, f"$.{k}", "variant") for k in keys]
    kinds = [F.schema_of_variant(v) for v in values]
    lists = [F.coalesce(F.try_variant_get(parsed, f"$.{k}", "array<variant>"), none) for k in keys]
    every = F.flatten(F.array(*lists))
    fits = F.forall(every, lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False)))
    for kind in kinds:
        fits = fits & (kind.isNull() | kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "STRING"))
    names = F.transform(every, lambda e: F.try_variant_get(e, "$", "string"))
    return F.when(F.coalesce(whole & fits, F.lit(False)), _norm_set(names)).otherwise(F.array().cast("array<string>"))


def entity_set(entity_map) -> Column:
    """``map<type, array<surface>>`` -> flat lower-cased distinct set (type ignored)."""
    vals = F.flatten(F.map_values(F.coalesce(_c(entity_map),
                                             F.create_map().cast("map<string,array<string>>"))))
    return _norm_set(vals)


_SPAN = "struct<type_id:int,pos:int,surface:string>"


def bio_spans(tokens, tags) -> Column:
    """N6, row form: BIO tag ids -> array of spans ``struct(type_id, pos, surface)``.

    B opens a span, I extends it only while one is open (its type is not compared), anything
    else closes it; an orphan I is dropped.  Tag ids: 0 = O, odd = B, even > 0 = I, type =
    (tag - 1) div 2.

    Linear in the number of tokens, no shuffle: take the positions of all non-I tokens, zip
    each with the next such position (or the end), and keep the pairs that start at a B - each
    is one span running up to the next non-I token.  I tokens after an O or at the start belong
    to no such pair and vanish.  Both position arrays are top-level arguments, never read
    inside a lambda, so nothing is recomputed per element."""
    tk, tg = _c(tokens), _c(tags)
    n = F.size(tg)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (tg[i] == 0) | (tg[i] % 2 == 1))
    nexts = F.concat(F.slice(starts, 2, F.greatest(n, F.lit(1))), F.array(n))
    pairs = F.arrays_zip(starts.alias("s"), nexts.alias("e"))
    spans = F.transform(
        F.filter(pairs, lambda x: tg[x["s"]] % 2 == 1),
        lambda x: F.struct(((tg[x["s"]] - 1) / 2).cast("int").alias("type_id"), x["s"].alias("pos"),
                           F.array_join(F.slice(tk, x["s"] + 1, x["e"] - x["s"]), " ").alias("surface")))
    return F.when(n > 0, spans.cast(f"array<{_SPAN}>")).otherwise(F.array().cast(f"array<{_SPAN}>"))
