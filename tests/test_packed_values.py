import json

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators.packed_values import tokenize, unpack

CASES = [
    (None, True, []),
    ("", True, []),
    (" \t\n", True, []),
    ("[]", True, []),
    ("a, b,, c ,", True, ["a", "b", "c"]),
    ("a, b; c", False, ["a, b", "c"]),
    ('"a, b","c; d"', False, ["a, b", "c; d"]),
    ('"so-called ""dark"" frames, averaged"; x', True, ['so-called "dark" frames, averaged', "x"]),
    ("scattering\\, small-angle, FAQ", True, ["scattering, small-angle", "FAQ"]),
    ('["b\\u00fasqueda", "a \\"x\\" b", ["c", d]]', True, ["búsqueda", 'a "x" b', "c", "d"]),
    ("[a, CI/CD]", True, ["a", "CI/CD"]),
    ("(1) a\n(2) b", True, ["a", "b"]),
    ("1. a; 2. b", True, ["a", "b"]),
    ("• a • b", True, ["a", "b"]),
    ("– 3D imaging\r\n– 2 x", True, ["3D imaging", "2 x"]),
    ("in-situ/operando cells / / CI/CD / ", True, ["in-situ/operando cells", "CI/CD"]),
    ("a<br/>b<BR>c", True, ["a", "b", "c"]),
    ("a||b | c", True, ["a", "b", "c"]),
    ("Bayes' rule、x；y · z", True, ["Bayes' rule", "x", "y", "z"]),
    ('"never closed, x', True, ['"never closed', "x"]),
    ('5" disk, y', True, ['5" disk', "y"]),
    ("a, a", True, ["a", "a"]),
    ("[x] y, z", True, ["[x] y", "z"]),
]


def test_cases():
    for text, comma, want in CASES:
        assert tokenize(text, comma) == want, text


values = st.lists(
    st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Z", "Cs"], exclude_characters="\\\"'“„«"), min_size=1, max_size=8),
    max_size=6,
)


@settings(max_examples=150, deadline=None)
@given(values)
def test_json_and_csv_round_trip(vals):
    assert tokenize(json.dumps(vals)) == vals
    assert tokenize(json.dumps(vals), False) == vals
    assert tokenize(";".join('"' + v + '"' for v in vals), False) == vals


def test_long_unclosed_quotes_stay_linear():
    assert len(tokenize('"a;' * 100_000)) == 100_000


def test_unpack(spark):
    rows = spark.createDataFrame(
        [(1, "a, b", None, 9), (2, "", "x, y; z", 9), (2, "", "x, y; z", 9)], "record_id long, k string, t string, pos int"
    )
    got = sorted(map(tuple, unpack(rows, "record_id", {"k": True, "t": False}).collect()))
    assert got == [(1, "k", 0, "a"), (1, "k", 1, "b"), *[(2, "t", 0, "x, y")] * 2, *[(2, "t", 1, "z")] * 2]
    assert unpack(rows.limit(0), "record_id", {"k": True}).count() == 0
