from __future__ import annotations

from watchglass.llm import quality_rules


def test_cut_between_zeros_and_the_first_positive_value():
    """Few rows are above zero; all junk is, some of it by little."""
    rows = [({"symbol_share": 0.0}, False)] * 2900 + [({"symbol_share": 0.001 * i}, True) for i in range(1, 200)]
    rules = quality_rules.learn(rows)
    assert [any(quality_rules._covers(rule, v) for rule in rules) for v, _ in rows] == [t for _, t in rows]
