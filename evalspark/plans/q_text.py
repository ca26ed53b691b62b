"""Catalog section: preparation (P*), normalisation (N3-N7, N9), text metrics (M3-M7, M10,
M18) and statistics (T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import fixtures as fx
from evalspark.config import ENTITY_TYPES
from evalspark.functions.entities import bio_spans, entity_set, parse_entities
from evalspark.functions.labels import label_name
from evalspark.functions.text import clean_code, cut_at_stop, token_set, truncate
from evalspark.operators import chat as C
from evalspark.operators import metrics as M
from evalspark.operators import prepare as P
from evalspark.operators import rouge as R
from evalspark.operators import stats as T
from evalspark.oracle import H, exact_mean_sql, lcs_sql, stem_ctes, with_fixtures
from evalspark.plans.benchmark import fixture_matrix
from evalspark.plans.catalog import register, round_report
from evalspark.plans.q_core import matrix_sql
from evalspark.session import read_table

NL = "\n"
WS = r"'^\s+|\s+$'"


def _sorted_join(arr):
    return F.array_join(F.array_sort(arr), "|")


# ---------------------------------------------------------------- P1-P3
_B1 = H("concat('42', ':', cast(doc_id AS varchar))")
_B2 = H("concat('42:2', ':', cast(doc_id AS varchar))")
_SPLIT3 = f"CASE WHEN {_B1} % 10000 < 8000 THEN 'train' WHEN {_B1} % 10000 < 9000 THEN 'validation' ELSE 'test' END"


@register("p1_split3", f"SELECT doc_id, {_SPLIT3} AS split FROM documents")
def p1_split3(spark, sf):
    return P.split3(read_table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("p2_split2", f"""SELECT doc_id, CASE WHEN s = 'train' THEN
        CASE WHEN {_B2} % 10000 < 9000 THEN 'train' ELSE 'validation' END ELSE s END AS split
    FROM (SELECT doc_id, {_SPLIT3} AS s FROM documents) q""")
def p2_split2(spark, sf):
    d = P.split3(read_table(spark, sf, "documents").select("doc_id"), "doc_id")
    return P.split2(d, "doc_id")


@register("p3_first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def p3_first_n(spark, sf):
    return P.first_n(read_table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id")


@register("p3_hash_sample", f"""SELECT doc_id, lang FROM documents
    ORDER BY {H("concat('42', ':', cast(doc_id AS varchar))")} % 1073741824, doc_id LIMIT 100""")
def p3_hash_sample(spark, sf):
    return P.first_n(read_table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id", sample="hash")


# ---------------------------------------------------------------- P4, P5, P10
_QMAP = {0: "bad", 1: "good"}


@register("p4_label_name", """SELECT doc_id, CASE quality WHEN 0 THEN 'bad' WHEN 1 THEN 'good' END AS quality_label,
        CASE toxic WHEN 0 THEN 'clean' WHEN 1 THEN 'toxic' END AS toxic_label FROM labels""")
def p4_label_name(spark, sf):
    lab = read_table(spark, sf, "labels")
    return lab.select("doc_id", label_name("quality", _QMAP, strict=True).alias("quality_label"),
                      label_name("toxic", {0: "clean", 1: "toxic"}, strict=True).alias("toxic_label"))


@register("p10_class_distribution", "SELECT quality, count(*) AS n FROM labels GROUP BY quality")
def p10_class_distribution(spark, sf):
    return P.class_distribution(read_table(spark, sf, "labels"), "quality")


# S2 parsing of a '<sentence>@<label>' line, DuckDB formulation
_PH_PARSE = f"""SELECT doc_id, regexp_replace(line, {WS}, '', 'g') AS l FROM phrase"""
_PH_SPLIT = r"""SELECT doc_id, regexp_extract(l, '(?s)^(.*)@([^@]*)$', 1) AS sentence,
        lower(regexp_replace(regexp_extract(l, '(?s)^(.*)@([^@]*)$', 2), '^\s+|\s+$', '', 'g')) AS sentiment
    FROM ph WHERE l <> '' AND contains(l, '@')"""


@register("p5_label_to_id", with_fixtures(
    """SELECT doc_id, sentence, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 END AS label
    FROM sp WHERE sentiment IN ('negative', 'neutral', 'positive')""", "phrase",
    extra=[("ph", _PH_PARSE), ("sp", _PH_SPLIT)]))
def p5_label_to_id(spark, sf):
    from evalspark.sources.text_label import parse_label_lines

    parsed = parse_label_lines(fx.phrase(spark, sf), "line", keep=("doc_id",))
    from evalspark.config import FINANCIAL_LABEL_TO_ID

    return P.label_to_id(parsed, "sentiment", FINANCIAL_LABEL_TO_ID).select("doc_id", "sentence", "label")


# ---------------------------------------------------------------- P6-P9
@register("p6_join_tokens", "SELECT conv_id, turn, array_to_string(string_split(text, ' '), ' ') AS text FROM conversations")
def p6_join_tokens(spark, sf):
    t = fx.ner_tokens(spark, sf)
    return P.tokens_to_text(t).select("conv_id", "turn", "text")


@register("p7_truncate", "SELECT doc_id, substr(text, 1, 80) AS snippet FROM documents")
def p7_truncate(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", truncate("text", 80).alias("snippet"))


QUALITY_TEMPLATE = "Rate the quality of this document (bad / good):\n{text}\nQuality:"
_PROMPT_SQL = "concat('Rate the quality of this document (bad / good):', chr(10), substr(d.text, 1, 400), chr(10), 'Quality:')"
_FMT = f"""SELECT d.doc_id, {_PROMPT_SQL} AS prompt, CASE l.quality WHEN 0 THEN 'bad' WHEN 1 THEN 'good' END AS completion
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


def _formatted(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return P.format_samples(d.join(lab, "doc_id"), QUALITY_TEMPLATE, "text",
                            label_name("quality", _QMAP, strict=True))


@register("p8_format_prompts", _FMT)
def p8_format_prompts(spark, sf):
    return _formatted(spark, sf).select("doc_id", "prompt", "completion")


def _ids_sql(x: str) -> str:
    return f"list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> ''), lambda t: ({H('t')} % 50000)::int)"


@register("p9_training_examples", with_fixtures(
    """SELECT doc_id, array_to_string(ids, ',') AS input_ids,
        array_to_string(list_transform(generate_series(1, len(ids)), lambda i: CASE WHEN i <= plen THEN -100 ELSE ids[i] END), ',') AS labels,
        len(ids)::int AS n_tokens, least(plen, len(ids))::int AS n_masked
    FROM (SELECT doc_id, len(p) AS plen, (p || c)[1:128] AS ids FROM pc) q""", extra=[
        ("fmt", _FMT), ("pc", f"SELECT doc_id, {_ids_sql('prompt')} AS p, {_ids_sql('completion')} AS c FROM fmt")]))
def p9_training_examples(spark, sf):
    t = P.training_examples(_formatted(spark, sf), max_length=128)
    return t.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("labels", ",").alias("labels"), F.size("input_ids").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x == -100)).alias("n_masked"))


# ---------------------------------------------------------------- P11, P12
_W = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda t: t <> '')"
_G8 = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))"


@register("p11_ngram_overlap", f"""WITH dw AS (SELECT doc_id, {_W} AS w FROM documents),
     bw AS (SELECT item_id, {_W} AS w FROM benchmark),
     dg AS (SELECT DISTINCT doc_id, unnest({_G8}) AS g FROM dw),
     bg AS (SELECT DISTINCT item_id, unnest({_G8}) AS g FROM bw)
    SELECT dg.doc_id, count(DISTINCT bg.item_id) AS n_items, count(DISTINCT dg.g) AS n_shared_ngrams
    FROM dg JOIN bg ON bg.g = dg.g GROUP BY dg.doc_id""")
def p11_ngram_overlap(spark, sf):
    return P.ngram_overlap(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), n=8)


_COPIES = r"""SELECT d.doc_id, count(*) AS n_items FROM documents d JOIN {items} b
    ON sha256(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g'))) = sha256(trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')))
    GROUP BY d.doc_id"""


@register("p11_exact_copies", _COPIES.format(items="benchmark"))
def p11_exact_copies(spark, sf):
    return P.exact_overlap(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@register("p11_copies_of_turns", """WITH t AS (SELECT concat(conv_id, '/', turn) AS doc_id, text FROM conversations), k AS (SELECT cast(doc_id AS varchar) AS doc_id,
        sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key FROM documents UNION ALL SELECT doc_id,
        sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) FROM t), n AS (SELECT key, count(*) AS n_items FROM k GROUP BY key)
    SELECT doc_id, n_items FROM k JOIN n USING (key)""")
def p11_copies_of_turns(spark, sf):
    """Exact copies within one collection (documents and single turns): every text with the size
    of its group of copies."""
    turns = read_table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text")
    texts = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(turns)
    return P.exact_overlap(texts, texts, item_id="doc_id")


@register("p12_chat_format", """SELECT conv_id, string_agg(concat('<|', role, '|>', text, '<|end|>'), '' ORDER BY turn) AS chat,
        count(*)::int AS n_turns FROM conversations GROUP BY conv_id""")
def p12_chat_format(spark, sf):
    return P.chat_format(read_table(spark, sf, "conversations"))


@register("p12_chat_segments", """SELECT conv_id, turn,
        coalesce(sum(length(seg)) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS offset, seg AS segment
    FROM (SELECT conv_id, turn, concat('<|', role, '|>', text, '<|end|>') AS seg FROM conversations) q""")
def p12_chat_segments(spark, sf):
    return P.chat_segments(read_table(spark, sf, "conversations"))


_HEAD = """concat('<|begin_of_text|><|start_header_id|>system<|end_header_id|>', chr(10), chr(10), 'Cutting Knowledge Date: December 2023',
    chr(10), 'Today Date: 26 Jul 2024', chr(10), chr(10), {system}, '<|eot_id|>')"""
_HEADER_IDS = rf"""WITH n AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
    s AS (SELECT conv_id, turn, concat(
            CASE WHEN k = 1 AND role = 'system' THEN {_HEAD.format(system="body")} WHEN k = 1 THEN {_HEAD.format(system="''")} ELSE '' END,
            CASE WHEN k = 1 AND role = 'system' THEN ''
                 ELSE concat('<|start_header_id|>', role, '<|end_header_id|>', chr(10), chr(10), body, '<|eot_id|>') END,
            CASE WHEN k = m THEN concat('<|start_header_id|>assistant<|end_header_id|>', chr(10), chr(10)) ELSE '' END) AS segment FROM n)
    SELECT conv_id, turn, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS offset, segment FROM s"""


@register("p12_header_template", _HEADER_IDS)
def p12_header_template(spark, sf):
    return C.render_segments(read_table(spark, sf, "conversations"), C.HEADER_IDS, add_generation_prompt=True)


@register("p12_role_template", """SELECT conv_id, turn,
        coalesce(sum(length(seg)) OVER (PARTITION BY conv_id ORDER BY turn
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS offset,
        concat(seg, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN '<|assistant|>' ELSE '' END) AS segment
    FROM (SELECT conv_id, turn, concat('<|', role, '|>', text, '<|end|>') AS seg FROM conversations) q""")
def p12_role_template(spark, sf):
    return C.render_segments(read_table(spark, sf, "conversations"), C.ROLE_MARKS, add_generation_prompt=True)


# ---------------------------------------------------------------- N3, N4 (generated code)
_STOPS_SQL = "list_min([" + ", ".join(
    f"nullif(instr(code, {s}), 0)" for s in
    ["chr(10) || 'class'", "chr(10) || 'def'", "chr(10) || '#'", "chr(10) || 'if __name__'", "chr(10) || 'print('"]) + "])"


@register("n3_cut_at_stop", with_fixtures(
    f"""SELECT sample_id, CASE WHEN cut IS NULL THEN code ELSE substr(code, 1, cut - 1) END AS solution
    FROM (SELECT sample_id, code, {_STOPS_SQL} AS cut FROM generations) q""", "generations"))
def n3_cut_at_stop(spark, sf):
    g = fx.generations(spark, sf)
    return g.select("sample_id", cut_at_stop("code").alias("solution"))


def _raw_and_prompt(g):
    raw = (F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit("```python" + NL), F.col("code"), F.lit(NL + "```")))
           .when(F.col("sample_id") % 3 == 1, F.substring_index(F.col("code"), NL, -1))
           .otherwise(F.col("code")))
    prompt = F.concat(F.lit("import math" + NL + "def f"), F.col("problem_id").cast("string"),
                      F.lit("(x):" + NL + "    # Return a value."))
    return g.select("sample_id", raw.alias("raw"), prompt.alias("prompt"))


_RAW_SQL = """SELECT sample_id,
        CASE WHEN sample_id % 3 = 0 THEN concat('```python', chr(10), code, chr(10), '```')
             WHEN sample_id % 3 = 1 THEN regexp_extract(code, '[^' || chr(10) || ']*$', 0)
             ELSE code END AS raw,
        concat('import math', chr(10), 'def f', cast(problem_id AS varchar), '(x):', chr(10), '    # Return a value.') AS prompt
    FROM generations"""
_CLEAN_SQL = r"""SELECT sample_id,
        regexp_replace(regexp_replace(regexp_replace(raw, '```(python)?', '', 'g'), '^`+|`+$', '', 'g'), '^\s+|\s+$', '', 'g') AS b,
        list_filter(string_split(prompt, chr(10)), lambda l: starts_with(regexp_replace(l, '^\s+', ''), 'def '))[-1] AS sig
    FROM rp"""


@register("n4_clean_code", with_fixtures(
    """SELECT sample_id, CASE WHEN contains(b, 'def ') THEN b WHEN sig IS NOT NULL THEN concat(sig, chr(10), b) ELSE b END AS code
    FROM cl""", "generations", extra=[("rp", _RAW_SQL), ("cl", _CLEAN_SQL)]))
def n4_clean_code(spark, sf):
    r = _raw_and_prompt(fx.generations(spark, sf))
    return r.select("sample_id", clean_code("raw", "prompt").alias("code"))


# ---------------------------------------------------------------- N5-N7, M5 (entities)
@register("n6_bio_spans", with_fixtures("SELECT * FROM ner_spans", "ner_spans"))
def n6_bio_spans(spark, sf):
    """Window form (gaps and islands over the exploded tokens)."""
    from pyspark.sql import Window

    t = fx.nertok(spark, sf)
    is_bo = ((F.col("tag") == 0) | (F.col("tag") % 2 == 1)).cast("int")
    w = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = t.withColumn("sid", F.sum(is_bo).over(w)).filter(F.col("tag") > 0)
    sp = g.groupBy("conv_id", "turn", "sid").agg(
        F.min("pos").alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("surface"),
        F.max(F.when(F.col("tag") % 2 == 1, F.col("tag"))).alias("btag"))
    return sp.filter(F.col("btag").isNotNull()).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), ((F.col("btag") - 1) / 2).cast("int").alias("type_id"),
        "surface")


@register("n6_bio_spans_rowwise", with_fixtures("SELECT * FROM ner_spans", "ner_spans"))
def n6_bio_spans_rowwise(spark, sf):
    """Row form: one ``aggregate`` per turn, no explode before the spans exist, no shuffle."""
    t = fx.ner_tokens(spark, sf)
    s = t.select("conv_id", "turn", F.explode(bio_spans("tokens", "tags")).alias("s"))
    return s.select("conv_id", "turn", F.col("s.pos").cast("bigint").alias("pos"), F.col("s.type_id").alias("type_id"),
                    F.col("s.surface").alias("surface"))


def _truth_sets(spark, sf):
    """Per turn: N6 spans -> entity dict {type: [surface]} -> N7 flat set."""
    t = fx.ner_tokens(spark, sf).select("conv_id", "turn", bio_spans("tokens", "tags").alias("spans"))
    return t.select("conv_id", "turn", _entities().alias("entities")).withColumn("truth", entity_set("entities"))


def _truth_and_pred(spark, sf):
    """Truth and model answer of a turn from its one row: no exchange, no join."""
    t = fx.ner_tokens(spark, sf).select("conv_id", "turn", bio_spans("tokens", "tags").alias("spans"))
    t = t.select("conv_id", "turn", entity_set(_entities()).alias("truth"), fx.ner_response("spans").alias("response"))
    none = F.array().cast("array<string>")
    return t.withColumn("pred", F.when(F.col("response").isNotNull(), F.coalesce(parse_entities("response"), none)).otherwise(none))


def _entities():
    spans = F.col("spans")  # projected once: referenced once per entity type below

    def of_type(k):
        return F.transform(F.filter(spans, lambda s: s["type_id"] == k), lambda s: s["surface"])

    per_type = [of_type(k) for k in range(len(ENTITY_TYPES))]
    ent = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in ENTITY_TYPES]), F.array(*per_type)),
                       lambda k, v: F.size(v) > 0)
    return ent


_TRUTH_SQL = """SELECT c.conv_id, c.turn, coalesce(s.truth, []) AS truth FROM conversations c LEFT JOIN (
        SELECT conv_id, turn, list(DISTINCT lower(trim(surface))) AS truth FROM ner_spans GROUP BY conv_id, turn) s
        ON s.conv_id = c.conv_id AND s.turn = c.turn"""


@register("n7_entity_set", with_fixtures(
    "SELECT conv_id, turn, array_to_string(list_sort(truth), '|') AS entities, len(truth)::int AS n_entities FROM truth",
    "ner_spans", extra=[("truth", _TRUTH_SQL)]))
def n7_entity_set(spark, sf):
    t = _truth_sets(spark, sf)
    return t.select("conv_id", "turn", _sorted_join("truth").alias("entities"), F.size("truth").alias("n_entities"))


_CLEAN_JSON = r"regexp_replace(regexp_replace(response, '```json|```', '', 'g'), '^\s+|\s+$', '', 'g')"
_PARSE_SQL = f"""SELECT conv_id, turn, CASE WHEN json_valid(cj) AND json_type(cj) = 'OBJECT' THEN
        list_distinct(list_transform(flatten([{", ".join(f"coalesce(try_cast(json_extract(cj, '$.{k}') AS VARCHAR[]), [])" for k in ENTITY_TYPES)}]),
                      lambda e: lower(trim(e)))) ELSE [] END AS pred
    FROM (SELECT conv_id, turn, {_CLEAN_JSON} AS cj FROM ner_pred) q"""


@register("n5_parse_entities", with_fixtures(
    "SELECT conv_id, turn, array_to_string(list_sort(pred), '|') AS entities, len(pred)::int AS n_entities FROM parsed",
    "ner_pred", extra=[("parsed", _PARSE_SQL)]))
def n5_parse_entities(spark, sf):
    p = fx.ner_pred(spark, sf)
    e = parse_entities("response")
    return p.select("conv_id", "turn", _sorted_join(e).alias("entities"), F.size(e).alias("n_entities"))


def _entity_scores(spark, sf):
    return M.entity_prf_scores(_truth_and_pred(spark, sf), "truth", "pred", keep=["conv_id", "turn"])


_PRF_SQL = """SELECT t.conv_id, t.turn, t.truth, coalesce(p.pred, []) AS pred,
        len(list_intersect(t.truth, coalesce(p.pred, []))) AS tp FROM truth t
        LEFT JOIN parsed p ON p.conv_id = t.conv_id AND p.turn = t.turn"""
_PRF2_SQL = """SELECT conv_id, turn,
        CASE WHEN len(truth) = 0 AND len(pred) = 0 THEN 1.0 WHEN len(pred) > 0 THEN tp / len(pred) ELSE 0.0 END AS precision,
        CASE WHEN len(truth) = 0 AND len(pred) = 0 THEN 1.0 WHEN len(truth) > 0 THEN tp / len(truth) ELSE 0.0 END AS recall
    FROM j"""
_ENT_CTES = [("truth", _TRUTH_SQL), ("parsed", _PARSE_SQL), ("j", _PRF_SQL), ("prf", _PRF2_SQL),
             ("scored", """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                 ELSE 0.0 END AS f1 FROM prf""")]


@register("m5_entity_prf", with_fixtures("SELECT conv_id, turn, precision, recall, f1 FROM scored", "ner_pred",
                                         extra=_ENT_CTES))
def m5_entity_prf(spark, sf):
    return _entity_scores(spark, sf)


@register("m5b_entity_correct", with_fixtures(
    "SELECT conv_id, turn, CAST(f1 >= 0.5 AS int) AS correct FROM scored", "ner_pred", extra=_ENT_CTES))
def m5b_entity_correct(spark, sf):
    return _entity_scores(spark, sf).select("conv_id", "turn", M.entity_correct("f1").alias("correct"))


@register("m5c_entity_means", with_fixtures(
    """SELECT concat('fmt', cast(turn % 4 AS varchar)) AS model, round(avg(precision), 6) AS precision,
        round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(CAST(f1 >= 0.5 AS int)), 6) AS accuracy
    FROM scored GROUP BY 1""", "ner_pred", extra=_ENT_CTES))
def m5c_entity_means(spark, sf):
    s = _entity_scores(spark, sf).withColumn("model", F.concat(F.lit("fmt"), (F.col("turn") % 4).cast("string")))
    g = s.groupBy("model").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                               F.avg("f1").alias("f1"), F.avg(M.entity_correct("f1")).alias("accuracy"))
    return round_report(g, ["precision", "recall", "f1", "accuracy"])


# ---------------------------------------------------------------- N9, M4 (token sets), M3 (ROUGE)
_TS = r"list_distinct(list_filter(string_split_regex(lower({x}), '\s+'), lambda t: t <> ''))"


@register("n9_token_set", with_fixtures(
    f"SELECT conv_id, turn, array_to_string(list_sort(s), '|') AS tokens, len(s)::int AS n_tokens FROM (SELECT conv_id, turn, {_TS.format(x='prediction')} AS s FROM pairs) q",
    "pairs"))
def n9_token_set(spark, sf):
    s = token_set("prediction")
    return fx.pairs(spark, sf).select("conv_id", "turn", _sorted_join(s).alias("tokens"), F.size(s).alias("n_tokens"))


_TF1 = f"""SELECT conv_id, turn, t, p, len(list_intersect(t, p)) AS tp FROM (SELECT conv_id, turn,
        {_TS.format(x='reference')} AS t, {_TS.format(x='prediction')} AS p FROM pairs) q"""
_TF2 = """SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN tp / len(p) ELSE 0.0 END AS precision, tp / len(t) AS recall
    FROM tf WHERE len(t) > 0"""
_TF3 = "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM tf2"


def _token_f1(spark, sf):
    p = fx.pairs(spark, sf)
    return M.token_f1_scores(p, token_set("reference"), token_set("prediction"), keep=["conv_id", "turn"])


@register("m4_token_f1", with_fixtures("SELECT * FROM tf3", "pairs", extra=[("tf", _TF1), ("tf2", _TF2), ("tf3", _TF3)]))
def m4_token_f1(spark, sf):
    return _token_f1(spark, sf)


@register("m4_token_f1_mean", with_fixtures("SELECT round(avg(f1), 6) AS f1, count(*) AS n FROM tf3", "pairs",
                                            extra=[("tf", _TF1), ("tf2", _TF2), ("tf3", _TF3)]))
def m4_token_f1_mean(spark, sf):
    return round_report(_token_f1(spark, sf).agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n")), ["f1"])


_RTOK = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '')"


def _rouge_sql(n: int) -> list:
    gram = "unnest(w)" if n == 1 else f"unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))"
    return [
        ("rt", f"""SELECT conv_id, turn, 'r' AS side, {_RTOK.format(x='reference')} AS w FROM pairs
                   UNION ALL SELECT conv_id, turn, 'p' AS side, {_RTOK.format(x='prediction')} AS w FROM pairs"""),
        ("tot", f"""SELECT conv_id, turn, max(CASE WHEN side = 'r' THEN greatest(len(w) - {n - 1}, 0) END) AS n_ref,
                   max(CASE WHEN side = 'p' THEN greatest(len(w) - {n - 1}, 0) END) AS n_pred FROM rt GROUP BY conv_id, turn"""),
        ("gr", f"SELECT conv_id, turn, side, {gram} AS g FROM rt"),
        ("cnt", """SELECT conv_id, turn, g, sum(CASE WHEN side = 'r' THEN 1 ELSE 0 END) AS cr,
                   sum(CASE WHEN side = 'p' THEN 1 ELSE 0 END) AS cp FROM gr GROUP BY conv_id, turn, g"""),
        ("ov", "SELECT conv_id, turn, sum(least(cr, cp)) AS overlap FROM cnt GROUP BY conv_id, turn"),
        ("pr", """SELECT t.conv_id, t.turn, coalesce(o.overlap, 0) / greatest(t.n_pred, 1) AS precision,
                   coalesce(o.overlap, 0) / greatest(t.n_ref, 1) AS recall
                   FROM tot t LEFT JOIN ov o ON o.conv_id = t.conv_id AND o.turn = t.turn"""),
        ("rs", "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f FROM pr"),
    ]


@register("m3a_rouge1", with_fixtures("SELECT * FROM rs", "pairs", extra=_rouge_sql(1)))
def m3a_rouge1(spark, sf):
    return R.rouge_n(fx.pairs(spark, sf), ["conv_id", "turn"], n=1)


@register("m3a_rouge2", with_fixtures("SELECT * FROM rs", "pairs", extra=_rouge_sql(2)))
def m3a_rouge2(spark, sf):
    return R.rouge_n(fx.pairs(spark, sf), ["conv_id", "turn"], n=2)


@register("m3c_rouge1_mean", with_fixtures(
    "SELECT concat('m', cast(conv_id % 3 AS varchar)) AS model, round(avg(f), 6) AS mean_f, count(*) AS n FROM rs GROUP BY 1",
    "pairs", extra=_rouge_sql(1)))
def m3c_rouge1_mean(spark, sf):
    s = R.rouge_n(fx.pairs(spark, sf), ["conv_id", "turn"], n=1)
    g = R.mean_scores(s.withColumn("model", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))), ["model"])
    return round_report(g, ["mean_f"])


_RL_TOK = ("rlt", f"SELECT conv_id, turn, {_RTOK.format(x='reference')} AS r, {_RTOK.format(x='prediction')} AS p FROM pairs")
_RL_STEM = [
    ("rlw", "SELECT DISTINCT unnest(r || p) AS tok FROM rlt"), *stem_ctes("rlw"),
    ("rlu", """SELECT conv_id, turn, 'r' AS side, unnest(r) AS tok, generate_subscripts(r, 1) AS i FROM rlt
               UNION ALL SELECT conv_id, turn, 'p', unnest(p), generate_subscripts(p, 1) FROM rlt"""),
    ("rls", """SELECT conv_id, turn, coalesce(list(stem ORDER BY i) FILTER (WHERE side = 'r'), []) AS r,
               coalesce(list(stem ORDER BY i) FILTER (WHERE side = 'p'), []) AS p FROM rlu JOIN stems USING (tok) GROUP BY conv_id, turn"""),
    ("rlj", "SELECT t.conv_id, t.turn, coalesce(s.r, []) AS r, coalesce(s.p, []) AS p FROM rlt t LEFT JOIN rls s USING (conv_id, turn)")]


def _rouge_l_ctes(stemmed: bool) -> list:
    source = "rlj" if stemmed else "rlt"
    return [_RL_TOK, *(_RL_STEM if stemmed else []),
            ("rll", f"SELECT conv_id, turn, len(r) AS nr, len(p) AS np, ({lcs_sql('r', 'p')})::int AS lcs FROM {source}"),
            ("rlp", """SELECT conv_id, turn, lcs, CASE WHEN nr > 0 AND np > 0 THEN lcs / np ELSE 0.0 END AS precision,
                CASE WHEN nr > 0 AND np > 0 THEN lcs / nr ELSE 0.0 END AS recall FROM rll"""),
            ("rlf", """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f
                FROM rlp""")]


@register("m3b_rouge_l", with_fixtures("SELECT * FROM rlf", "pairs", extra=_rouge_l_ctes(False)))
def m3b_rouge_l(spark, sf):
    return R.rouge_l(fx.pairs(spark, sf), ["conv_id", "turn"])


@register("m3b_rouge_l_stemmed", with_fixtures("SELECT * FROM rlf", "pairs", extra=_rouge_l_ctes(True)))
def m3b_rouge_l_stemmed(spark, sf):
    return R.rouge_l(fx.pairs(spark, sf), ["conv_id", "turn"], stem=True)


# ---------------------------------------------------------------- M6, M7, M10, M18 (generations)
_PAK = """SELECT model, k, round(avg(pak), 6) AS pass_at_k, count(pak) AS n_problems FROM (
        SELECT model, k, CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0
            ELSE 1.0 - list_reduce(list_transform(range(0, k), lambda i: (n - c - i)::double / (n - i)), lambda a, b: a * b) END AS pak
        FROM (SELECT model, problem_id, count(*) AS n, sum(passed) AS c FROM generations GROUP BY model, problem_id) g,
             (VALUES (1), (3), (10)) AS ks(k)) q GROUP BY model, k"""


@register("m6_pass_at_k", with_fixtures(_PAK, "generations"))
def m6_pass_at_k(spark, sf):
    return round_report(M.pass_at_k(fx.generations(spark, sf), ks=(1, 3, 10)), ["pass_at_k"])


@register("m7_greedy_pass", with_fixtures(
    """SELECT model, avg(passed::double) AS pass_at_1, sum(passed)::bigint AS n_passed, count(*) AS n
    FROM generations WHERE config = 'greedy' GROUP BY model""", "generations"))
def m7_greedy_pass(spark, sf):
    return M.greedy_pass(fx.generations(spark, sf))


@register("m10_output_length", with_fixtures(
    "SELECT model, avg(length(code)::double) AS mean_chars, avg(length(code) / 4) AS mean_est_tokens FROM generations GROUP BY model",
    "generations"))
def m10_output_length(spark, sf):
    return M.output_length(fx.generations(spark, sf))


@register("m18_compare_configs", with_fixtures(
    """SELECT model, problem_id, s AS sampled_pass, g AS greedy_pass, s - g AS delta FROM (
        SELECT model, problem_id, avg(CASE WHEN config = 'sampled' THEN passed::double END) AS s,
               avg(CASE WHEN config = 'greedy' THEN passed::double END) AS g
        FROM generations GROUP BY model, problem_id) q""", "generations"))
def m18_compare_configs(spark, sf):
    return M.compare_configs(fx.generations(spark, sf))


# ---------------------------------------------------------------- T1-T4
_CAND = "(starts_with(model, '1') OR starts_with(model, '2'))"
_T_PAIRS = f"""SELECT c.model AS slm, b.model AS llm_baseline, c.unit, c.score AS slm_score, b.score AS llm_score
    FROM (SELECT * FROM paired WHERE {_CAND}) c JOIN (SELECT * FROM paired WHERE NOT {_CAND}) b ON b.unit = c.unit"""


def _is_cand():
    return F.col("model").startswith("1") | F.col("model").startswith("2")


@register("t4_pair_grid", with_fixtures("SELECT slm, llm_baseline, count(*) AS n_units FROM tp GROUP BY 1, 2", "paired",
                                        extra=[("tp", _T_PAIRS)]))
def t4_pair_grid(spark, sf):
    return T.pair_grid(fx.paired(spark, sf), _is_cand())


@register("t1_paired_t", with_fixtures(
    """SELECT slm, llm_baseline, round(avg(slm_score), 6) AS slm_mean_accuracy, round(avg(llm_score), 6) AS llm_mean_accuracy,
        round(avg(slm_score - llm_score), 6) AS mean_difference, round(stddev_samp(slm_score - llm_score), 6) AS sd_difference,
        count(*) AS n_pairs,
        round(avg(slm_score - llm_score) / (stddev_samp(slm_score - llm_score) / sqrt(count(*))), 6) AS t_statistic
    FROM tp GROUP BY slm, llm_baseline""", "paired", extra=[("tp", _T_PAIRS)]))
def t1_paired_t(spark, sf):
    return round_report(T.paired_t(fx.paired(spark, sf), _is_cand(), with_p=False),
                        ["slm_mean_accuracy", "llm_mean_accuracy", "mean_difference", "sd_difference", "t_statistic"])


def _t_stats_sql(pairs: str) -> list:
    """CTEs (name, sql) ending in ``tpv``: statistics with a two-sided p-value as a finite sum."""
    odd = "list_sum(list_transform(range(0, greatest((df - 1) // 2, 0)), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: 2.0::double * i / (2 * i + 1) * c2)), 1.0)))"
    even = "list_sum(list_transform(range(0, df // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: (2.0::double * i - 1) / (2 * i) * c2)), 1.0)))"
    return [
        ("tst", f"""SELECT slm, llm_baseline, avg(slm_score) AS slm_mean_accuracy, avg(llm_score) AS llm_mean_accuracy,
            avg(slm_score - llm_score) AS mean_difference, stddev_samp(slm_score - llm_score) AS sd_difference, count(*) AS n_pairs
            FROM {pairs} GROUP BY slm, llm_baseline"""),
        ("tsv", "SELECT *, mean_difference / nullif(sd_difference / sqrt(n_pairs), 0) AS t_statistic, n_pairs - 1 AS df FROM tst"),
        ("tsa", "SELECT *, atan(abs(t_statistic) / sqrt(df)) AS a, pow(cos(atan(abs(t_statistic) / sqrt(df))), 2) AS c2 FROM tsv"),
        ("tpv", f"""SELECT *, CASE WHEN t_statistic IS NULL OR df < 1 THEN NULL
            WHEN df % 2 = 1 THEN 1 - 2 / pi() * (a + coalesce(sin(a) * cos(a) * {odd}, 0)) ELSE 1 - sin(a) * {even} END AS p_value FROM tsa""")]


_STATS = ["slm_mean_accuracy", "llm_mean_accuracy", "mean_difference", "sd_difference", "t_statistic", "p_value"]


@register("t2_t3_p_values", with_fixtures(
    f"""SELECT slm, llm_baseline, {", ".join(f"round({c}, 6) AS {c}" for c in _STATS)}, n_pairs,
        p_value < 0.05 AS significant_at_0_05 FROM tpv""", "paired", extra=[("tp", _T_PAIRS), *_t_stats_sql("tp")]))
def t2_t3_p_values(spark, sf):
    return round_report(T.paired_t(fx.paired(spark, sf), _is_cand(), with_p=True), _STATS)


_SIG_PAIRS = """SELECT c.model AS slm, b.model AS llm_baseline, c.x AS slm_score, b.x AS llm_score
    FROM (SELECT model, task, avg(accuracy) AS x FROM matrix WHERE model NOT IN ('gpt-4o', 'gemini-2.5-flash') GROUP BY 1, 2) c
    JOIN (SELECT model, task, avg(accuracy) AS x FROM matrix WHERE model IN ('gpt-4o', 'gemini-2.5-flash') GROUP BY 1, 2) b USING (task)
    WHERE c.x IS NOT NULL AND b.x IS NOT NULL"""


@register("t_significance_table", matrix_sql(
    f"""SELECT slm, llm_baseline, {", ".join(f"round({c}, 4) AS {c}" for c in _STATS if c != "sd_difference")},
        p_value < 0.05 AS "significant_at_0.05", n_pairs::int AS n_pairs FROM tpv""",
    extra=[("sigp", _SIG_PAIRS), *_t_stats_sql("sigp")]))
def t_significance_table(spark, sf):
    """B8 -> T1-T3: the compiled matrix as the nine-column significance table, unit = task."""
    return T.significance_table(fixture_matrix(spark, sf), ~F.col("model").isin("gpt-4o", "gemini-2.5-flash"))


# ---------------------------------------------------------------- M17 across tasks
def _lat(model_col, id_col):
    """Fixture latency in seconds for rows that carry none: 0.1 .. 12.1 s from a hash."""
    from evalspark.functions.hashing import h32

    return (F.lit(100) + h32(F.concat(F.lit("lat"), model_col, id_col.cast("string"))) % 12000).cast("double") / 1000


def _lat_sql(model_sql, id_sql):
    return f"cast(100 + {H(f'concat(' + chr(39) + 'lat' + chr(39) + f', {model_sql}, cast({id_sql} AS varchar))')} % 12000 AS double) / 1000"


_NER_MODEL = "concat('fmt', cast(turn % 4 AS varchar))"
_NER_LAT = _lat_sql(_NER_MODEL, "conv_id * 100 + turn")
_SUM_MODEL = "concat('m', cast(conv_id % 3 AS varchar))"
_MT_ROWS = f"""SELECT model, 'classification' AS task, 'label_match' AS match_mode,
        CASE WHEN coalesce(list_filter(['bad', 'good'], lambda l: contains(lower(prediction), lower(l)))[1], 'bad') = true_label
             THEN 1.0::double ELSE 0.0::double END AS score, latency_s FROM predictions
    UNION ALL SELECT {_NER_MODEL}, 'ner', 'entity', f1::double, {_NER_LAT} FROM scored
    UNION ALL SELECT {_NER_MODEL}, 'ner', 'token_set', f1::double, {_NER_LAT} FROM ntf3
    UNION ALL SELECT {_SUM_MODEL}, 'summarization', 'rouge_l_stemmed', f::double, {_lat_sql(_SUM_MODEL, "conv_id * 100 + turn")} FROM rlf
    UNION ALL SELECT model, 'code_generation', 'pass_at_1', c::double / n, lat FROM (
        SELECT model, problem_id, count(*) AS n, sum(passed) AS c, cast(sum(cast(floor({_lat_sql("model", "sample_id")} * 1e6 + 0.5) AS hugeint)) AS double) / count(*) / 1e6 AS lat
        FROM generations WHERE config = 'sampled' GROUP BY model, problem_id) z"""
_NTF = [("ntf", f"""SELECT t.conv_id, t.turn, {_TS.format(x="array_to_string(list_sort(t.truth), ' ')")} AS t,
            {_TS.format(x="coalesce(r.response, '')")} AS p FROM truth t LEFT JOIN ner_pred r USING (conv_id, turn)"""),
        ("ntf1", "SELECT *, len(list_intersect(t, p)) AS tp FROM ntf"),
        ("ntf2", """SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN CASE WHEN len(p) > 0 THEN tp / len(p) ELSE 0.0 END END AS precision,
            CASE WHEN len(t) > 0 THEN tp / len(t) END AS recall FROM ntf1"""),
        ("ntf3", "SELECT *, CASE WHEN recall IS NULL THEN NULL WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM ntf2")]
_MT_SC = [
    ("allrows", _MT_ROWS),
    ("g", f"""SELECT model, task, match_mode, count(*) AS n_samples, {exact_mean_sql("score", 10 ** 9, 4)} AS accuracy,
        {exact_mean_sql("latency_s * 1000", 10 ** 3, 2)} AS latency_ms FROM allrows GROUP BY model, task, match_mode"""),
    ("t", """SELECT *, CASE task WHEN 'classification' THEN 32 WHEN 'financial_sentiment' THEN 32 WHEN 'ner' THEN 64
        WHEN 'summarization' THEN 128 WHEN 'code_generation' THEN 256 END / (latency_ms / 1000) AS tokens_per_second FROM g"""),
    ("c", "SELECT *, round(2.5 / (tokens_per_second * 3600) * 1e6, 4) AS cost_per_1m_tokens FROM t"),
]
_MT_CTES = _rouge_l_ctes(True) + _ENT_CTES + _NTF + _MT_SC


def _multitask_scores(spark, sf):
    """One plan, every task scored by its own metric (``match_mode``).  A conversation's turn
    is scored in both NER modes from one row."""
    from evalspark.plans.scorecard import classification_scores

    cls = classification_scores(fx.predictions(spark, sf), fx.PRED_LABELS).select(
        "model", "task", F.lit("label_match").alias("match_mode"), "score", "latency_s")
    ner_model = F.concat(F.lit("fmt"), (F.col("turn") % 4).cast("string"))
    both = _truth_and_pred(spark, sf).select(
        "conv_id", "turn", "truth", "pred",
        token_set(F.array_join(F.array_sort("truth"), " ")).alias("tt"), token_set(F.coalesce("response", F.lit(""))).alias("pt"))
    modes = [M.entity_prf_scores(both, "truth", "pred", keep=["conv_id", "turn"]).withColumn("match_mode", F.lit("entity")),
             M.token_f1_scores(both, "tt", "pt", keep=["conv_id", "turn"], drop_empty=False).withColumn("match_mode", F.lit("token_set"))]
    ner = modes[0].unionByName(modes[1]).select(
        ner_model.alias("model"), F.lit("ner").alias("task"), "match_mode", F.col("f1").alias("score"),
        _lat(ner_model, F.col("conv_id") * 100 + F.col("turn")).alias("latency_s"))
    sm_model = F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))
    summ = R.rouge_l(fx.pairs(spark, sf), ["conv_id", "turn"], stem=True).select(
        sm_model.alias("model"), F.lit("summarization").alias("task"), F.lit("rouge_l_stemmed").alias("match_mode"),
        F.col("f").alias("score"), _lat(sm_model, F.col("conv_id") * 100 + F.col("turn")).alias("latency_s"))
    gen = fx.generations(spark, sf).filter(F.col("config") == "sampled").withColumn("latency_s", _lat(F.col("model"), F.col("sample_id")))
    code = M.problem_scores(gen).select("model", F.lit("code_generation").alias("task"), F.lit("pass_at_1").alias("match_mode"),
                                        "score", "latency_s")
    return cls.unionByName(ner).unionByName(summ).unionByName(code)


def _multitask_scorecard(spark, sf):
    from evalspark.plans.scorecard import scorecard

    return scorecard(_multitask_scores(spark, sf), by=("model", "task", "match_mode"))


@register("m17_multitask_scorecard", with_fixtures(
    """SELECT model, task, match_mode, n_samples, accuracy, latency_ms, tokens_per_second, cost_per_1m_tokens, 'low' AS privacy_risk,
        CASE WHEN 10.0 - cost_per_1m_tokens <= 0 THEN 'inf'::double
             ELSE round(0.0 / (10.0 - cost_per_1m_tokens) * 1e6, 0) END AS roi_breakeven_tokens
    FROM c""", "predictions", "generations", "pairs", "ner_pred", extra=_MT_CTES))
def m17_multitask_scorecard(spark, sf):
    return _multitask_scorecard(spark, sf)


@register("m17_scorecard_levels", with_fixtures(
    f"""SELECT CASE WHEN grouping(model) = 0 AND grouping(task) = 0 THEN 'model, task' WHEN grouping(model) = 0 THEN 'model'
            WHEN grouping(task) = 0 THEN 'task' ELSE 'total' END AS level, model, task, count(*) AS n_samples,
        {exact_mean_sql("score", 10 ** 9, 4)} AS accuracy, {exact_mean_sql("latency_s * 1000", 10 ** 3, 2)} AS latency_ms
    FROM allrows WHERE match_mode <> 'entity' GROUP BY GROUPING SETS ((model, task), (model), (task), ())""",
    "predictions", "generations", "pairs", "ner_pred", extra=_MT_CTES))
def m17_scorecard_levels(spark, sf):
    """M17 over levels: model and task, each alone, and all rows, from one aggregate."""
    from evalspark.plans.scorecard import scorecard_levels

    return scorecard_levels(_multitask_scores(spark, sf).filter(F.col("match_mode") != "entity"))


@register("s7_scorecard_to_matrix", with_fixtures(
    """SELECT regexp_replace(model, '^.*/', '') AS model, task, 'API' AS method, accuracy, latency_ms, cost_per_1m_tokens,
        'low' AS privacy_risk, CASE WHEN 10.0 - cost_per_1m_tokens <= 0 THEN 'inf'::double
             ELSE round(0.0 / (10.0 - cost_per_1m_tokens) * 1e6, 0) END AS roi_breakeven_tokens
    FROM c WHERE match_mode <> 'entity'""", "predictions", "generations", "pairs", "ner_pred", extra=_MT_CTES))
def s7_scorecard_to_matrix(spark, sf):
    """Scorecard -> benchmark records (S7) -> matrix."""
    from evalspark.operators.matrix import compile_matrix
    from evalspark.plans.scorecard import benchmark_records

    card = _multitask_scorecard(spark, sf).filter(F.col("match_mode") != "entity")
    runs = benchmark_records(card, "phase2_evaluation", F.sha2(F.concat_ws("/", "model", "task"), 256),
                             F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return compile_matrix(runs, None, {})


# ---------------------------------------------------------------- T1 at item level
_ITEM = f"""SELECT c.model AS slm, b.model AS llm_baseline, c.score AS slm_score, b.score AS llm_score
    FROM (SELECT model, sample_id, CASE WHEN coalesce(list_filter(['bad', 'good'], lambda l: contains(lower(prediction), lower(l)))[1], 'bad') = true_label THEN 1.0 ELSE 0.0 END AS score
          FROM predictions) c
    JOIN (SELECT model, sample_id, CASE WHEN coalesce(list_filter(['bad', 'good'], lambda l: contains(lower(prediction), lower(l)))[1], 'bad') = true_label THEN 1.0 ELSE 0.0 END AS score
          FROM predictions) b ON b.sample_id = c.sample_id
    WHERE c.model = 'm0' AND b.model <> 'm0'"""


@register("t1_item_level_paired_t", with_fixtures(
    """SELECT slm, llm_baseline, round(avg(slm_score), 6) AS slm_mean_accuracy, round(avg(llm_score), 6) AS llm_mean_accuracy,
        round(avg(slm_score - llm_score), 6) AS mean_difference, round(stddev_samp(slm_score - llm_score), 6) AS sd_difference,
        count(*) AS n_pairs,
        round(avg(slm_score - llm_score) / (stddev_samp(slm_score - llm_score) / sqrt(count(*))), 6) AS t_statistic
    FROM ip GROUP BY slm, llm_baseline""", "predictions", extra=[("ip", _ITEM)]))
def t1_item_level_paired_t(spark, sf):
    """T1 with the sample as pairing unit: every unit contributes #candidates x #baselines rows."""
    from evalspark.plans.scorecard import classification_scores

    s = classification_scores(fx.predictions(spark, sf), fx.PRED_LABELS) \
        .select("model", F.col("sample_id").alias("unit"), "score")
    out = T.paired_t(s, F.col("model") == "m0", with_p=False)
    return round_report(out, ["slm_mean_accuracy", "llm_mean_accuracy", "mean_difference", "sd_difference", "t_statistic"])
