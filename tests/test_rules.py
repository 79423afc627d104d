from collections import Counter

import pytest

from keysieve.sources.rules import Rule, RuleSet, load_rules


def test_catalogue_shape():
    rules = load_rules().rules
    assert Counter(r.kind for r in rules) == {
        "keyvalue": 258, "prefix": 94, "endpoint": 18, "contains": 8}
    assert len({r.id for r in rules}) == 378
    assert [r.ord for r in rules] == list(range(1, 379))
    assert len(load_rules().literals("k")) == 550


def test_subset():
    rules = load_rules().subset("github-pat, npm-token", ["npm-token"])
    assert [r.id for r in rules.rules] == ["github-pat"]
    with pytest.raises(ValueError):
        load_rules().subset("github-pat", "github-pat")


def test_broadcast_bound():
    with pytest.raises(ValueError):
        RuleSet((Rule("x", "X", "keyvalue", tuple(f"k{i}" for i in range(60_000)), 8),))


def test_table(spark):
    df = load_rules().to_df(spark)
    assert df.count() == 378
    assert df.where("specificity = 0").count() == 4


def test_custom_rule(scan_lines):
    mine = RuleSet((Rule("acme-key", "Acme Key", "prefix", ("acme_",), 15, "Hex", ord=1),))
    assert scan_lines(["id acme_0123456789"], rules=mine) == [
        (1, 4, "acme-key", "acme_0123456789")]
