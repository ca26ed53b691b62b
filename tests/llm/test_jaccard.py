import pytest

from evalspark.llm import graph, jaccard
from tests.llm.conftest import ascii_lower, brute_components, split_words, texts_of, words


def test_query_equals_brute_force(spark, sf):
    want = brute_components(texts_of(spark.read.parquet(f"{sf}/documents.parquet")))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op4_jaccard_join(spark, sf).collect()}
    assert got == want and any(c != i for i, (_, c) in want.items())


@pytest.mark.parametrize("options", [{}, {"minima": 1, "chunk_rows": 2}])
def test_awkward_rows(awkward, options):
    rows = texts_of(awkward)
    want = brute_components([r for r in rows if r[0] is not None])
    got = jaccard.jaccard_components(awkward, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r["doc_id"]


def test_no_link_is_lost_without_stars(spark):
    """With the stars left out every link must come from the exact completion."""
    base, rows = words(11, 200), []
    for i in range(40):
        w = list(base) if i % 2 else words(12 + i // 2, 200)
        for k in range(i % 9):
            w[k * 23 % 200] = f"edit{i}-{k}"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "doc_id")
    want = brute_components(rows)
    stars, jaccard._stars = jaccard._stars, lambda classes, percent: stars(classes, percent).where("a < 0")
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame, chunk_rows=7).collect()}
    finally:
        jaccard._stars = stars
    assert got == want


def brute_links(rows):
    """({(a, b)} of class representatives, {id: number of links}) by comparing all pairs of sets."""
    sets = {i: frozenset(tuple(w[k: k + 5]) for k in range(max(len(w) - 4, min(1, len(w)))))
            for i, w in ((i, split_words(ascii_lower(t)) if t else []) for i, t in rows)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    linked = lambda x, y: x and 100 * len(x & y) >= 80 * len(x | y)
    pairs = {(rep[x], rep[y]) for x in rep for y in rep if rep[x] < rep[y] and linked(x, y)}
    counts = {i: sum(j != i and bool(linked(s, t)) for j, t in sets.items()) for i, s in sets.items() if s}
    return pairs, counts


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 2}, {"chunk_bytes": 2000}])
def test_join_gives_every_link(spark, awkward, options):
    base, rows = words(21, 150), []
    for i in range(30):
        w = list(base) if i % 3 else words(30 + i // 3, 150)
        for k in range(i % 4):
            w[(k * 31 + i) % 150] = f"edit{i}-{k}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 4)]
    rows += [r for r in texts_of(awkward) if r[0] is not None and r not in rows and len(r[1] or "") < 5000]
    rows = sorted(set(rows), key=str)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, members = jaccard.jaccard_pairs(frame, **options)
    want, counts = brute_links(rows)
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["id"]: r["n_links"] for r in jaccard.link_counts(pairs, members).collect()} == counts


def test_very_long_texts_meet_in_bounded_tiles(spark):
    """Texts of 20,000 words that share passages, in chunks of a few kilobytes."""
    base, rows = [f"{w}{k}" for k, w in enumerate(words(41, 20_000))], []
    for i in range(6):
        own = [f"own{i}-{k}" for k in range(20_000)]
        cut = (1500, 4000, 17_000, 18_900, 19_500, 20_000)[i]
        rows.append((i, " ".join(base[:cut] + own[cut:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    got = jaccard.jaccard_components(frame, minima=1, chunk_bytes=50_000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert want[4][1] == want[5][1] and want[0][1] == 0


def test_empty_table(nothing):
    pairs, members = jaccard.jaccard_pairs(nothing)
    assert pairs.collect() == members.collect() == []
    assert jaccard.jaccard_components(nothing).collect() == []


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 9, 9), (2, "A B c", 9, 9)], "doc_id long, text string, n_shingles int, component_id int")
    assert {tuple(r) for r in jaccard.jaccard_components(rows).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_an_id_with_two_texts_links_by_either(spark):
    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (11, "else where")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(rows).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11)}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[1000 + i] for i in range(40)}) == 1
    assert len(set(roots.values())) == 2 and len(got) == 101
