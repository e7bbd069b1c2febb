"""The YAML reader."""

import pytest

from siltstone.sources import writers
from siltstone.sources.config import parse_yaml

TEXT = """---
# a comment
name: corpus one   # another
url: https://example.org/a#b
ratio: 0.25
small: 1.5e-4
count: -3
on: true
none:
tilde: ~
quoted: "a: \\"b\\" # c"
single: 'it''s'
list:
- 1
- two words
-
  - nested
  - [x, {y: 1, z: [2.0, "q, r"]}, ]
maps:
  - key: a
    value: {}
  - key: b
    value: []
deep:
  one:
    two: three
"""


def test_values():
    assert parse_yaml(TEXT) == {
        "name": "corpus one", "url": "https://example.org/a#b", "ratio": 0.25, "small": 1.5e-4, "count": -3, "on": True, "none": None, "tilde": None,
        "quoted": 'a: "b" # c', "single": "it's", "list": [1, "two words", ["nested", ["x", {"y": 1, "z": [2.0, "q, r"]}]]],
        "maps": [{"key": "a", "value": {}}, {"key": "b", "value": []}], "deep": {"one": {"two": "three"}},
    }
    assert parse_yaml("") is None and parse_yaml("# only\n") is None and parse_yaml("- a\n- b: 1") == ["a", {"b": 1}] and parse_yaml("word") == "word"


@pytest.mark.parametrize("text", ["a: &x 1", "a: *x", "a: |\n  b", "a: !t b", "a: 1\na: 2", "a: 1\n  b: 2", "\ta: 1", "a: [1, 2", "a: 1\n---\nb: 2", "a: 1\nplain"])
def test_what_is_not_read(text):
    with pytest.raises(ValueError):
        parse_yaml(text)


def test_ledger_is_read_back(spark):
    rows = [("s", "CC-BY 4.0", "https://example.org/x"), ("t", "it's: mine", "u")]
    ledger = parse_yaml(writers.license_ledger(spark.createDataFrame(rows, "source string, license string, url string")))
    found = str(ledger)
    assert all(x in found or x.replace("'", "\\'") in found for r in rows for x in r)
