"""String / array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.config import STOP_SEQUENCES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The characters that Python's str.strip() and str.split() take for white space.
WHITE = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def strip_ws(x) -> Column:
    """Remove leading/trailing whitespace as ``str.strip()`` does, no-break spaces included."""
    return F.regexp_replace(_c(x), rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def join_tokens(tokens, sep: str = " ") -> Column:
    """Token array -> text."""
    return F.array_join(_c(tokens), sep)


def truncate(text, n: int) -> Column:
    """First ``n`` characters (code points, like Python slicing)."""
    return F.substring(_c(text), 1, n)


def render_prompt(template: str, text, max_chars: int | None = 400) -> Column:
    """One literal replacement of ``{text}`` in the template; braces inside the text are
    never interpreted."""
    body = _c(text) if max_chars is None else truncate(text, max_chars)
    pre, _, post = template.partition("{text}")
    return F.concat(F.lit(pre), body, F.lit(post))


def short_model(model) -> Column:
    """Part after the last '/'."""
    return F.substring_index(_c(model), "/", -1)


def token_set(text) -> Column:
    """Distinct lower-case whitespace tokens (empty text -> empty array)."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), f"[{WHITE}]+"), lambda t: t != ""))


def word_tokens(text, pattern: str = r"[^a-z0-9]+") -> Column:
    """Lower-case, replace every run matching ``pattern`` by a blank, split, drop empties
    (the ROUGE tokeniser with the default pattern)."""
    return F.filter(F.split(F.lower(_c(text)), pattern), lambda t: t != "")


def cut_at_stop(text, stops=STOP_SEQUENCES) -> Column:
    """Cut at the earliest stop marker; unchanged when none occurs."""
    t = _c(text)
    positions = [F.nullif(F.locate(s, t), F.lit(0)) for s in stops]
    first = F.least(*positions) if len(positions) > 1 else positions[0]
    return F.when(first.isNull(), t).otherwise(t.substr(F.lit(1), first - 1))


def clean_code(raw, prompt) -> Column:
    """Strip code fences; without a ``def `` prepend the prompt's last ``def`` line."""
    body = strip_ws(F.regexp_replace(F.regexp_replace(_c(raw), r"```(python)?", ""), r"^`+|`+$", ""))
    lines = F.split(_c(prompt), "\n")
    sig = F.try_element_at(F.filter(lines, lambda l: F.regexp_replace(l, r"^\s+", "").startswith("def ")), F.lit(-1))
    return (F.when(body.contains("def "), body)
            .when(sig.isNotNull(), F.concat(sig, F.lit("\n"), body))
            .otherwise(body))
