"""Python helpers (Porter stemmer, LCS, incomplete beta) against published values and brute force."""

import itertools
import math
import random

import pytest

from evalspark.functions.porter import stem
from evalspark.operators.rouge import lcs_length
from evalspark.operators.stats import t_two_sided_p

# Word -> stem after all five steps of the 1980 algorithm (words from its worked examples).
PORTER_EXAMPLES = [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("caress", "caress"), ("cats", "cat"),
    ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"),
    ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
    ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"),
    ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
    ("rational", "ration"), ("valenci", "valenc"), ("hesitanci", "hesit"), ("digitizer", "digit"),
    ("conformabli", "conform"), ("radicalli", "radic"), ("differentli", "differ"), ("vileli", "vile"),
    ("analogousli", "analog"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"),
    ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("callousness", "callous"),
    ("formaliti", "formal"), ("sensitiviti", "sensit"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"),
    ("formative", "form"), ("formalize", "formal"), ("electriciti", "electr"), ("electrical", "electr"),
    ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"),
    ("airliner", "airlin"), ("gyroscopic", "gyroscop"), ("adjustable", "adjust"), ("defensible", "defens"),
    ("irritant", "irrit"), ("replacement", "replac"), ("adjustment", "adjust"), ("dependent", "depend"),
    ("adoption", "adopt"), ("homologou", "homolog"), ("communism", "commun"), ("activate", "activ"),
    ("angulariti", "angular"), ("homologous", "homolog"), ("effective", "effect"), ("bowdlerize", "bowdler"),
    ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    ("generalizations", "gener"), ("oscillators", "oscil"),
]


@pytest.mark.parametrize("word,expect", PORTER_EXAMPLES)
def test_porter(word, expect):
    assert stem(word) == expect


def _lcs_dp(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_lcs_matches_dynamic_programming():
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        assert lcs_length(a, b) == _lcs_dp(a, b)


def test_t_tail_known_values():
    assert t_two_sided_p(1.0, 1.0) == pytest.approx(0.5) and t_two_sided_p(2.0, 2.0) == pytest.approx(1 - 2 / math.sqrt(6))
    assert t_two_sided_p(-1.96, 5e6) == pytest.approx(0.0499958, abs=1e-6)  # normal limit
    assert t_two_sided_p(1.7, 199_999) == pytest.approx(t_two_sided_p(1.7, 200_001), abs=1e-6)
    # t = 2.776 with 4 df is the 97.5% quantile -> two-sided p = 0.05
    assert t_two_sided_p(2.776445, 4.0) == pytest.approx(0.05, abs=1e-5)
    assert t_two_sided_p(0.0, 10.0) == pytest.approx(1.0)
    assert math.isnan(t_two_sided_p(1.0, 0.0))
