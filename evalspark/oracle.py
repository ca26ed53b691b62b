"""DuckDB-dialect SQL for the fixture views (FIXTURES.md part B) and a ``WITH`` builder.

Used only by ``__spark_entry__.oracle_sql()``: an independent formulation of each query that
DuckDB runs on the same Parquet tables."""

from __future__ import annotations


def H(x: str) -> str:
    """32-bit md5 prefix as BIGINT (same value as ``evalspark.functions.h32``)."""
    return f"(('0x'||substr(md5({x}),1,8))::bigint)"


_hk = H("concat(m.model, ':', cast(l.doc_id AS varchar))")

FIXTURE_SQL = {
    "predictions": f"""
SELECT l.doc_id AS sample_id, m.model AS model, 'classification' AS task,
       CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS true_label,
       CASE WHEN {_hk} % 10 = 0 THEN 'error'
            WHEN {_hk} % 10 = 1 THEN 'I cannot say'
            WHEN {_hk} % 10 IN (2, 3) THEN CASE WHEN l.quality = 1 THEN 'Answer: BAD.' ELSE 'Answer: GOOD.' END
            WHEN {_hk} % 10 IN (4, 5) THEN CASE WHEN l.quality = 1 THEN ' good ' ELSE ' bad ' END
            ELSE CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END END AS prediction,
       cast(100 + {H("concat('lat', m.model, cast(l.doc_id AS varchar))")} % 12000 AS double) / 1000 AS latency_s
FROM labels l CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) AS m(model)""",
    "generations": """
SELECT event_type AS model, user_id AS problem_id, event_id AS sample_id,
       CASE WHEN event_id % 2 = 0 THEN 'sampled' ELSE 'greedy' END AS config,
       CASE WHEN value > 35 THEN 1 ELSE 0 END AS passed,
       concat('def f(x):', chr(10), '    return ', cast(event_id AS varchar),
              CASE event_id % 4 WHEN 0 THEN concat(chr(10), 'print(f(1))')
                                WHEN 1 THEN concat(chr(10), '# done', chr(10), 'class A:')
                                WHEN 2 THEN concat(chr(10), 'def g(y):') ELSE '' END) AS code
FROM events""",
    "runs": """
SELECT md5(cast(event_id AS varchar)) AS run_id, ts AS start_time, event_id % 2 AS store,
       concat('org', cast(user_id % 2 AS varchar), '/m', cast(user_id % 6 AS varchar)) AS model,
       event_type AS task,
       CASE event_id % 3 WHEN 0 THEN 'phase2_fine_tuning' WHEN 1 THEN 'phase2_benchmark'
                         ELSE 'phase1_baseline' END AS phase,
       CASE WHEN user_id % 6 >= 3 THEN 'low' ELSE 'high' END AS privacy_risk,
       CASE WHEN user_id % 2 = 0 THEN 'LoRA' ELSE 'QLoRA' END AS method,
       least(value / 100, 1.0) AS accuracy,
       100 + value * 10 AS latency_ms,
       1 + value / 10 AS cost_per_1m_tokens,
       value / 100 AS training_hours
FROM events""",
    "pairs": """
SELECT u.conv_id AS conv_id, u.turn AS turn, u.text AS reference, a.text AS prediction
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "phrase": """
SELECT doc_id, concat(replace(text, chr(10), ' '), '@',
       CASE doc_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN ' Neutral ' WHEN 2 THEN 'positive'
                       WHEN 3 THEN 'a@positive' ELSE 'mixed' END) AS line
FROM documents""",
    "tokens": """
SELECT conv_id, turn, unnest(string_split(text, ' ')) AS tok,
       generate_subscripts(string_split(text, ' '), 1) - 1 AS pos
FROM conversations""",
    "nertok": f"""
SELECT conv_id, turn, pos, tok,
       CASE WHEN NOT cap THEN 0
            WHEN coalesce(lag(cap) OVER (PARTITION BY conv_id, turn ORDER BY pos), false) THEN 2 * ({H("tok")} % 4) + 2
            ELSE 2 * ({H("tok")} % 4) + 1 END AS tag
FROM (SELECT *, regexp_matches(tok, '^[A-Z]') AS cap FROM tokens) z""",
    "ner_spans": """
WITH g AS (SELECT *, sum(CASE WHEN tag = 0 OR tag % 2 = 1 THEN 1 ELSE 0 END) OVER (
               PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
           FROM nertok),
     sp AS (SELECT conv_id, turn, sid, min(pos) AS pos, string_agg(tok, ' ' ORDER BY pos) AS surface,
                   max(CASE WHEN tag % 2 = 1 THEN tag END) AS btag
            FROM g WHERE tag > 0 GROUP BY conv_id, turn, sid)
SELECT conv_id, turn, pos, cast((btag - 1) // 2 AS int) AS type_id, surface FROM sp WHERE btag IS NOT NULL""",
    "ner_pred": """
WITH k AS (SELECT conv_id, turn, pos, surface,
                  row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rk
           FROM ner_spans),
     j AS (SELECT conv_id, turn,
                  concat('{"PER": ', to_json(coalesce(list(surface ORDER BY pos) FILTER (WHERE rk % 3 <> 0), [])), '}') AS js
           FROM k GROUP BY conv_id, turn)
SELECT conv_id, turn,
       CASE WHEN turn % 4 = 1 THEN concat('```json', chr(10), js, chr(10), '```')
            WHEN turn % 4 = 3 THEN substr(js, 1, 10) ELSE js END AS response
FROM j""",
    "paired": """
SELECT o_orderpriority AS model, date_trunc('month', o_orderdate) AS unit, avg(o_totalprice) AS score
FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)""",
    "scenarios": """
SELECT concat('s', cast(c_custkey AS varchar)) AS scenario,
       (['click', 'error', 'purchase', 'signup', 'view'])[cast(c_nationkey % 5 AS int) + 1] AS task,
       cast((c_custkey::bigint * 7919) % 50000000 AS bigint) AS monthly_volume,
       cast(c_custkey % 160 AS double) / 100 AS min_accuracy, c_custkey % 3 = 0 AS privacy_required
FROM customer""",
}

# Dependencies between fixture views (a view must follow the ones it reads).
FIXTURE_DEPS = {
    "nertok": ["tokens"],
    "ner_spans": ["tokens", "nertok"],
    "ner_pred": ["tokens", "nertok", "ner_spans"],
}


def with_fixtures(body: str, *names: str, extra=()) -> str:
    """Prefix ``body`` with ``WITH`` clauses for the named fixture views (and their deps),
    followed by ``extra`` ``(name, sql)`` clauses of the query itself."""
    order: list[str] = []
    for n in names:
        for d in FIXTURE_DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    parts = [(n, FIXTURE_SQL[n]) for n in order] + list(extra)
    ctes = ",\n".join(f"{n} AS ({q}\n)" for n, q in parts)
    return f"WITH {ctes}\n{body}" if ctes else body


def exact_mean_sql(x: str, unit: int, digits: int) -> str:
    """The same exact, half-up rounded mean as ``plans.scorecard.exact_mean``, in whole numbers."""
    step = unit // 10 ** digits
    total = f"sum(cast(floor(({x}) * {float(unit)}::double + 0.5) AS hugeint))"
    n = f"count({x})::hugeint"
    return f"cast(({total} * 2 + {n} * {step}) // nullif({n} * {2 * step}, 0) AS double) / {float(10 ** digits)}"


# --- stems and longest common subsequences, by regular expressions and lists -------------------

def _cv(x: str) -> str:
    """``x`` with every y that sounds as a vowel (after a consonant) written as i."""
    return (f"regexp_replace(regexp_replace(regexp_replace({x}, '^yy', 'yi'), '([aeiou])yy', '\\1yi', 'g'), "
            f"'([^aeiouy])y', '\\1i', 'g')")


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({_cv(x)}, '{pattern}')"


def _drop(x: str, n: int) -> str:
    return f"substr({x}, 1, length({x}) - {n})"


def _m0(x: str) -> str:
    return _has(x, "^[^aeiou]*[aeiou]+[^aeiou]")


def _m1(x: str) -> str:
    return _has(x, "^[^aeiou]*[aeiou]+[^aeiou]+[aeiou]+[^aeiou]")


def _cvc(x: str) -> str:
    return (f"((length({x}) > 2 AND {_has(x, '[^aeiou][aeiou][^aeiouwxy]$')}) OR "
            f"(length({x}) = 2 AND {_has(x, '^[aeiou][^aeiou]$')}))")


def _ends(x: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in suffixes) + ")"


def _rules(x: str, pairs, condition) -> str:
    """The longest matching suffix decides; it is replaced if ``condition`` holds for the rest."""
    cases = " ".join(f"WHEN {_ends(x, s)} THEN CASE WHEN {condition(_drop(x, len(s)), s)} THEN {_drop(x, len(s))} || '{r}' ELSE {x} END"
                     for s, r in sorted(pairs, key=lambda p: -len(p[0])))
    return f"CASE {cases} ELSE {x} END"


def stem_ctes(words: str) -> list:
    """CTEs that end in ``stems (tok, stem)`` for the tokens of the CTE ``words (tok)``."""
    from evalspark.functions.porter import IRREGULAR, STEP2, STEP3, STEP4  # the fixed tables only

    w, b = "w", "b"
    last = f"substr({b}, length({b}))"
    twin = f"(length({b}) > 1 AND substr({b}, length({b})) = substr({b}, length({b}) - 1, 1) AND {_has(b, '[^aeiou]$')})"
    irregular = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    step4 = _rules(w, [(s, "") for s in STEP4], lambda x, s: f"({_m1(x)}" + (f" AND {_ends(x, 's', 't')})" if s == "ion" else ")"))
    steps = [
        f"""CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {_drop(w, 1)} WHEN {_ends(w, 'sses', 'ies')} THEN {_drop(w, 2)}
            WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN {_drop(w, 1)} ELSE w END""",
        None,
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND {_has(_drop(w, 1), '[^aeiou]$')} THEN {_drop(w, 1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {_m0(_drop(w, 4))} THEN {_drop(w, 2)} ELSE w END",
        f"CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {_m0(_drop(w, 3))} THEN {_drop(w, 1)} ELSE w END ELSE {_rules(w, STEP2, lambda x, s: _m0(x))} END",
        _rules(w, STEP3, lambda x, s: _m0(x)),
        step4,
        f"""CASE WHEN ends_with(w, 'e') AND ({_m1(_drop(w, 1))} OR ({_m0(_drop(w, 1))} AND NOT {_cvc(_drop(w, 1))}))
            THEN {_drop(w, 1)} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {_m1(_drop(w, 1))} THEN {_drop(w, 1)} ELSE w END",
    ]
    out = [("st0", f"SELECT DISTINCT tok, tok AS w FROM {words} WHERE length(tok) > 3 AND (CASE tok {irregular} END) IS NULL")]
    for i, step in enumerate(steps):
        before = f"st{i}"
        if step is None:  # -ed and -ing: cut first, then mend the rest
            cut = (f"SELECT tok, w, CASE WHEN {_ends(w, 'ied', 'eed')} THEN NULL WHEN ends_with(w, 'ed') AND {_has(_drop(w, 2), '[aeiou]')} "
                   f"THEN {_drop(w, 2)} WHEN ends_with(w, 'ing') AND {_has(_drop(w, 3), '[aeiou]')} THEN {_drop(w, 3)} END AS b FROM {before}")
            sql = f"""SELECT tok, CASE WHEN b IS NOT NULL THEN CASE WHEN {_ends(b, 'at', 'bl', 'iz')} THEN b || 'e'
                WHEN {twin} THEN CASE WHEN {last} IN ('l', 's', 'z') THEN b ELSE {_drop(b, 1)} END
                WHEN {_m0(b)} AND NOT {_m1(b)} AND {_cvc(b)} THEN b || 'e' ELSE b END
                WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_drop(w, 1)} ELSE {_drop(w, 2)} END
                WHEN ends_with(w, 'eed') AND {_m0(_drop(w, 3))} THEN {_drop(w, 1)} ELSE w END AS w FROM ({cut}) q"""
        else:
            sql = f"SELECT tok, {step} AS w FROM {before}"
        out.append((f"st{i + 1}", sql))
    out.append(("stems", f"""SELECT tok, w AS stem FROM st{len(steps)} UNION ALL
        SELECT DISTINCT tok, coalesce(CASE WHEN length(tok) > 3 THEN CASE tok {irregular} END END, tok) FROM {words}
        WHERE length(tok) <= 3 OR (CASE tok {irregular} END) IS NOT NULL"""))
    return out


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists: rows of the dynamic programme, each a
    running maximum of the row before and of the diagonal where the elements agree."""
    rows = f"list_transform({a}, lambda x: list_transform({b}, lambda y: (y = x)::int))"
    zero = f"list_transform({b}, lambda y: 0)"
    best = "greatest(prev[j], same[j] * (coalesce(prev[j - 1], 0) + 1))"
    step = (f"list_transform(range(1, len(prev) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda j: {best})))")
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_max(list_reduce(list_prepend({zero}, {rows}), "
            f"lambda prev, same: {step})) END")
