import pytest

from folioscope.functions import lines as L


@pytest.mark.parametrize("line, kinds", [
    ("", set()), ("   ", set()), ("Plain prose of some words.", set()), ("| a | b |", {"table", "aligned", "rows", "verbatim"}), ("|---|:---:|", {"table", "aligned", "rows", "verbatim"}),
    ("a | b | c | d", {"table", "aligned", "rows", "verbatim"}), ("a | b | c. Then d | e", {"aligned", "rows", "verbatim"}), ("x || y || z", {"rows", "verbatim"}), ("one   two   three   four", {"aligned", "rows", "verbatim"}),
    ("    indented", {"code", "algorithm", "verbatim"}), ("a <- b", {"code", "algorithm", "symbols", "verbatim"}),
    ("Step 3: go on", {"code", "algorithm", "verbatim"}), ("Input: a key", {"code", "algorithm", "verbatim"}), ("x = y", {"math", "algorithm", "symbols", "verbatim"}), ("x ≤ y ⊕ z", {"math", "algorithm", "symbols", "verbatim"}),
    ("This is a sentence of many words that says the value x = y holds for every reader", {"symbols", "verbatim"}), (r"\(x\)", {"math", "algorithm", "symbols", "verbatim"}), ("$$ a || b | c | d", {"math", "algorithm", "symbols", "rows", "verbatim"}),
])
def test_kinds(line, kinds):
    assert {k for k in L.KINDS if L.is_kind(line, k)} == kinds


def test_numbered_lines():
    assert L.Sign.NUMBERED in L.read("12 : x") and L.Sign.NUMBERED not in L.read("x 12:")
