"""The two forms of the longest common subsequence."""
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.operators import rouge


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abce"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_all_forms_agree(a, b):
    want = table(a, b)
    assert rouge.lcs_length(a, b) == rouge.lcs_length(b, a) == want
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    if a and b:
        assert rouge._lcs_sparse(a, b) == rouge._lcs_bits(a, b) == want


def test_long_pairs_take_seconds():
    rnd = random.Random(1)
    a = [rnd.randrange(300_000) for _ in range(200_000)]
    b = [x if rnd.random() < 0.9 else rnd.randrange(300_000) for x in a if rnd.random() < 0.95]
    began = time.perf_counter()
    n = rouge.lcs_length(a, b)
    assert time.perf_counter() - began < 30 and 0.8 * len(a) < n < len(b)
    few = [x % 50 for x in a[:3000]], [x % 50 for x in b[:3000]]
    assert rouge.lcs_length(*few) == rouge._lcs_sparse(*few) == rouge._lcs_bits(*few)


def test_rows_of_rare_tokens_are_made_when_needed():
    rnd = random.Random(2)
    a, b = ([rnd.randrange(400) for _ in range(3000)] for _ in range(2))
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    assert rouge._lcs_bits(a, b) == rouge._lcs_sparse(a, b) == rouge.lcs_length(a, b)
