from noteweave.operators import raw_lines as R

SCHEMA = "line_id long, site_id string, file_name string, line_no int, raw_line string, kind string, extra int"


def lines(spark, rows):
    return spark.createDataFrame([(i, "s", f, n, r, "clash", 1) for i, (f, n, r) in enumerate(rows)], SCHEMA)


def test_reasons_in_order(spark):
    rows = [
        ("a.csv", 1, "code,description,is_valid_billable,category,inclusion_terms,exclusion_terms,synonyms"),
        ("a.csv", 2, "I50.21,Heart,1,I50,,,"),
        ("a.csv", 3, 'I50.21,He"art,1,I50,,,'),
        ("a.csv", 4, "I50.21,Heart,1"),
        ("a.csv", 5, "5021,Heart,1,I50,,,"),
        ("a.csv", 6, "I50.21,--,1,I50,,,"),
        ("a.csv", 7, "I50.21,Heart,maybe,I50,,,"),
        ("a.csv", 8, "   \r"),
        ("a.csv", 9, None),
        ("a.csv", 10, '﻿"I50.21","say ""x"", y",,I50,"a\nb",,\r'),
        ("b.TSV", 2, "I10\tHigh, very\tno\tI10\t\t\t"),
        ("b.tsv", 3, "CODE\t description\tis_valid_billable\tcategory\tinclusion_terms\texclusion_terms\tsynonyms"),
        ("a.csv", 11, '"I50.21,Heart,1'),
        ("a.csv", 12, ",,,,,,"),
    ]
    got = {r["line_id"]: r["reason"] for r in R.failed_lines(lines(spark, rows)).collect()}
    assert got == {2: "quoting", 3: "column_count", 4: "code", 5: "description", 6: "billable", 12: "quoting", 13: "code"}
    loaded = {r["line_id"]: r for r in R.loaded_rows(lines(spark, rows)).collect()}
    assert set(loaded) == {1, 9, 10}
    assert loaded[9]["description"] == 'say "x", y' and loaded[9]["inclusion_terms"] == "a\nb" and loaded[9]["is_valid_billable"] is None
    assert loaded[10]["is_valid_billable"] is False and loaded[10]["description"] == "High, very"


def test_empty_and_repeated(spark):
    assert R.failed_lines(lines(spark, [])).count() == 0
    twice = lines(spark, [("a.csv", 2, "x,y")]).unionByName(lines(spark, [("a.csv", 2, "x,y")]))
    assert R.failed_lines(twice).count() == 1


def test_long_line(spark):
    long = "I50.21,Heart,1,I50," + '"' + "a; " * 200_000 + '",,'
    assert R.failed_lines(lines(spark, [("a.csv", 2, long)])).count() == 0
