import pytest

from noteweave.operators import packed_fields as P


def split(text, wide=()):
    got = P._json_items(text.strip()) if text else None
    if got is not None:
        return [v.strip() for v in got if v.strip()]
    spans, kinds = P.lattice(text)
    if not spans:
        return []
    edges = P.edges_of(len(spans), list(wide))
    # what the column teaches: single values (and those given as wide) are known, joined ones aren't
    known = {e: 1.0 for e, (i, j) in enumerate(edges) if j - i == 1 or (i, j - i) in wide}
    path, firsts = P.viterbi([a for a, _ in spans], [b for _, b in spans], kinds, known, [0.9] * len(P.NAMES), 100.0, list(wide))
    assert firsts == [edges[e][0] for e in path]
    return [x for e in path if (x := P._clean(text[spans[edges[e][0]][0] : spans[edges[e][1] - 1][1]]))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b; c d", ["a b", "c d"]),
        ('"a; b"; c', ["a; b", "c"]),
        ("x (a; b)|y", ["x (a; b)", "y"]),
        ("1. one 2. two, too 3. three", ["one", "two, too", "three"]),
        ("(1) one (2) two", ["one", "two"]),
        ("· a\n· b, c", ["a", "b, c"]),
        ("a<br/>b<BR>c", ["a", "b", "c"]),
        ('["a, b", "c"]', ["a, b", "c"]),
        ('a, "b, c"', ["a", "b, c"]),
        ("a and/or b / c", ["a and/or b", "c"]),
        ("; a;; b ;", ["a", "b"]),
        ('"so-called ""x"""|y', ['so-called "x"', "y"]),
        ("a、b；c\td", ["a", "b", "c", "d"]),
        ("a; a", ["a", "a"]),
        ("N/A", []),
        ("", []),
        (None, []),
        ('5" x; y', ['5" x', "y"]),
    ],
)
def test_split(text, want):
    assert split(text) == want


def test_rows(spark):
    schema = "row_id long, inclusion_terms string, exclusion_terms string, synonyms string, item string"
    df = spark.createDataFrame([(1, "a; b; a", None, "-", "clash"), (2, "a; b; a", " ", "only", None), (3, None, "x|y", "N/A", "")], schema)
    got = sorted((r["row_id"], r["field_name"], r["item_no"], r["item"], r["n_items"]) for r in P.unpack(df.select("row_id", *P.FIELDS)).collect())
    assert got == [
        (1, "inclusion_terms", 1, "a", 3), (1, "inclusion_terms", 2, "b", 3), (1, "inclusion_terms", 3, "a", 3), (2, "inclusion_terms", 1, "a", 3), (2, "inclusion_terms", 2, "b", 3), (2, "inclusion_terms", 3, "a", 3),
        (2, "synonyms", 1, "only", 1), (3, "exclusion_terms", 1, "x", 2), (3, "exclusion_terms", 2, "y", 2),
    ]
    assert P.unpack(df.limit(0).select("row_id", *P.FIELDS)).count() == 0


def test_long_field():
    n = 20_000
    assert len(split("; ".join(f"value {k}" for k in range(n)))) == n


def test_value_with_many_commas(spark):
    """A known value of more spans than SPAN is found whole where it stands unquoted."""
    long = "cyst, left, upper, outer, recurrent, old"
    rows = [(i, f'"{long}"; x{i % 3}', None, None) for i in range(400)] + [(900, f"{long}, x1", None, None), (901, "x1, x2, x0, x1, x2, x0", None, None)]
    df = spark.createDataFrame(rows, "row_id long, inclusion_terms string, exclusion_terms string, synonyms string")
    got = {}
    for r in P.unpack(df).where("row_id >= 900").orderBy("item_no").collect():
        got.setdefault(r["row_id"], []).append(r["item"])
    assert got == {900: [long, "x1"], 901: ["x1", "x2", "x0", "x1", "x2", "x0"]}
