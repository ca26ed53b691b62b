"""Column-expression builders.  Every function returns a ``Column`` made of built-in
Spark SQL functions only, so it stays inside whole-stage codegen and needs no shuffle."""

from evalspark.functions.hashing import h32, hash_bucket  # noqa: F401
from evalspark.functions.text import (  # noqa: F401
    clean_code,
    cut_at_stop,
    join_tokens,
    render_prompt,
    short_model,
    strip_ws,
    token_set,
    truncate,
    word_tokens,
)
from evalspark.functions.labels import exact_match, is_error, label_name, match_label  # noqa: F401
from evalspark.functions.entities import bio_spans, entity_set, parse_entities  # noqa: F401
