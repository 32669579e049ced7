import pytest

from siltstone.errors import InvalidArgument, InvalidQuery
from siltstone.plans import predicate as P
from siltstone.sources.schema import Field, Schema

SCHEMA = Schema(4, (Field("i", "int"), Field("f", "float"), Field("s", "string"), Field("9x", "int")))


def test_schema_rules():
    for name in ("and", "OR", "Vector", "", "a-b", "x" * 64, "seq"):
        with pytest.raises(InvalidArgument):
            Schema(4, (Field(name, "int"),))
    with pytest.raises(InvalidArgument):
        Schema(4, (Field("a", "int"), Field("a", "float")))
    for dim in (0, 4097):
        with pytest.raises(InvalidArgument):
            Schema(dim)
    with pytest.raises(InvalidArgument):
        Schema(4, tuple(Field(f"f{k}", "int") for k in range(33)))
    assert Schema.from_json(SCHEMA.to_json()) == SCHEMA


@pytest.mark.parametrize("text", ["i <<< 5", "nope == 5", "i = 5", "i ! 5", "(i == 5", "i == 5)", "i == 'x'", "f > 'x'", "i ==", "== 5", "i == 5 AND", "i == 5 i == 6", "9x == 1", "i == +5", "f == .5", "i == 5e3", "i == 99999999999999999999", "s == 'open", "I == 5"])
def test_malformed(text):
    with pytest.raises(InvalidQuery):
        P.parse(text, SCHEMA)


def test_precedence_and_parentheses():
    a = P.parse("i == 1 OR i == 2 AND i == 3", SCHEMA)
    assert isinstance(a, P.Or) and isinstance(a.right, P.And)
    b = P.parse("(i == 1 or i == 2) and i == 3  ", SCHEMA)
    assert isinstance(b, P.And) and isinstance(b.left, P.Or)
    assert P.comparisons(b) == 3 and P.fields_of(b) == {"i"}


def test_empty():
    assert P.parse(None, SCHEMA) is None and P.parse("  ", SCHEMA) is None
    with pytest.raises(InvalidQuery):
        P.parse("", SCHEMA, strict=True)


def keys(spark, text, rows):
    df = spark.createDataFrame(rows, "k int, i long, f double, s string")
    return [r.k for r in df.where(P.compile_filter(text, SCHEMA)).orderBy("k").collect()]


ROWS = [(0, 10, 0.5, "cat"), (1, 30, float("nan"), "dog"), (2, None, 1.5, None), (3, -5, None, "42"), (4, 50, 2.25, "cat")]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("i == 10", [0]), ("i != 10", [1, 3, 4]), ("i > 10", [1, 4]), ("i >= 10", [0, 1, 4]), ("i < 10", [3]), ("i <= 10", [0, 3]), ("i == -5", [3]), ("i > 9.5", [0, 1, 4]),
        ("f > 1", [2, 4]), ("f >= 0.5", [0, 2, 4]), ("f < 100", [0, 2, 4]), ("f != 0.5", [1, 2, 4]), ("f == 1.5", [2]), ("f == 5.", []),
        ("s == 'cat'", [0, 4]), ("s != 'cat'", [1, 3]), ("s < 'z'", []), ("s == 42", [3]), ("i == 10 OR f == 1.5", [0, 2]), ("s > 'a' OR i == 50", [4]),
    ],
)
def test_semantics(spark, text, expected):
    assert keys(spark, text, ROWS) == expected
