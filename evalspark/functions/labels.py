"""Label normalisation and matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.config import ERROR_SENTINELS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def match_label(pred, labels: list[str], default: str | None = "first") -> Column:
    """The first label, in the given order, whose lower case occurs in the lower-case
    prediction.  ``default='first'`` falls back to ``labels[0]`` (parity); ``None`` leaves NULL."""
    arr = F.array(*[F.lit(x) for x in labels])
    p = F.lower(_c(pred))
    hit = F.get(F.filter(arr, lambda l: p.contains(F.lower(l))), 0)
    if default == "first":
        return F.coalesce(hit, F.lit(labels[0]))
    if default is None:
        return hit
    return F.coalesce(hit, F.lit(default))


def exact_match(pred, truth, lower: bool = False, strip: bool = True) -> Column:
    """1 when the (stripped, optionally lower-cased) prediction equals the label."""
    from evalspark.functions.text import strip_ws

    p = strip_ws(pred) if strip else _c(pred)
    t = _c(truth)
    if lower:
        p, t = F.lower(p), F.lower(t)
    return F.coalesce((p == t).cast("int"), F.lit(0))


def is_error(pred, sentinels=ERROR_SENTINELS) -> Column:
    """Prediction is a failure sentinel (or NULL)."""
    return _c(pred).isNull() | _c(pred).isin(*sentinels)


def label_name(label_id, label_map: dict, strict: bool = False) -> Column:
    """Id -> name through a literal map; ``strict`` raises on a missing key."""
    m = F.create_map(*[x for k, v in sorted(label_map.items()) for x in (F.lit(k), F.lit(v))])
    name = F.try_element_at(m, _c(label_id))
    if strict:
        return F.when(name.isNull(), F.raise_error(F.concat(F.lit("unknown label id "),
                                                            _c(label_id).cast("string")))).otherwise(name)
    return name
