import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from evidspark.functions.text import fold as tx_fold
from evidspark.functions import text as tx
from evidspark.operators.filters import Filters, build, date_bound, parse_query
from evidspark.operators.index import Item, match, parse_websearch, query_words
from evidspark.sources.files import safe_name, validate_golden


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


def test_fold_beyond_latin(spark):
    row = spark.createDataFrame([("Việt Й ώ Ångström ﬁ",)], "t string").select(tx_fold(F.col("t")).alias("f")).first()
    assert row.f == "viet и ω angstrom ﬁ"


def test_normalize(spark):
    cases = ["  A​b – C x ", "étude", "", None, "10− 20­"]
    for c in cases:
        assert one(spark, tx.normalize_for_match(F.col("t"), composed=False), t=c) == tx.normalize_value(c)
    assert tx.normalize_value("A – B") == "a-b"


def test_empty_needle_never_matches(spark):
    assert one(spark, tx.contains_normalized(F.col("a"), F.col("b")), a="abc", b="") is False


def test_numbers(spark):
    got = one(spark, tx.numbers_in(F.col("t")), t="HV1 0,5 m a 2 215 J16 5.10-6")
    assert got == ["0,5", "2", "215", "5.10", "6"]


@pytest.mark.parametrize("hay,number,want", [("je 2 215 m", "2215", True), ("je 12215", "2215", False), ("je 22150", "2215", False), ("0,5 m", "0,5", True), ("10,5 m", "0,5", False)])
def test_states_number(spark, hay, number, want):
    assert one(spark, tx.states_number(F.col("h"), F.col("n")), h=hay, n=number) is want


def test_uuid5(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("a", "žluť", ""):
        assert one(spark, tx.uuid5(space, F.col("t")), t=name) == str(uuid.uuid5(uuid.UUID(space), name))


def test_titles_match():
    assert tx.titles_match("P ehled p irodnich pom r", "Přehled přírodních poměrů")
    assert not tx.titles_match("Závěr", "Úvod")
    assert not tx.titles_match("", "Úvod")


def test_excerpt(spark):
    text = "x" * 60 + "match" + "y" * 60
    assert one(spark, tx.excerpt(F.col("t"), F.lit(61), F.lit(5)), t=text) == "…" + "x" * 45 + "[match]" + "y" * 45 + "…"


def test_context_prefix(spark):
    f = lambda *v: one(spark, tx.context_prefix(*[F.col(c) for c in "abcd"]), **dict(zip("abcd", v, strict=True)))
    assert f("T", "L", "R", " s ") == "KONTEXT: T, L, R. s"
    assert f("T", None, "R", None) == "KONTEXT: T, R."
    assert f(None, "", None, "s") == "KONTEXT: s"
    assert f(None, None, None, "") == ""


def test_date_bounds():
    assert date_bound("2019", True) == date(2019, 12, 31)
    assert date_bound("2020-02", True) == date(2020, 2, 29)
    assert date_bound("2019-13", False) is None
    assert date_bound("soon", False) is None


def test_parse_query():
    rest, f = parse_query('průzkum autor:"Jan Novák" od:2019 hloubka:3 autor:jiný druh:příloha')
    assert rest == "průzkum hloubka:3"
    assert (f.author, f.date_from, f.content_kind) == ("Jan Novák", date(2019, 1, 1), "annex")
    assert parse_query("poznámka: text")[0] == "poznámka: text"


def test_build_and_merge():
    f = build(author=[" a ", "a", ""], client=["x", "y"], document_ids=["no"], content_kind="telo")
    assert (f.author, f.client, f.document_ids, f.content_kind) == ("a", ("x", "y"), (), "prose")
    both = Filters(author="a", document_ids=("1",)).merge(Filters(author="b", client="c", document_ids=("2", "1")))
    assert (both.author, both.client, both.document_ids) == ("a", "c", ("1", "2"))
    assert Filters().is_empty() and "author ~ 'a'" in f.describe()


def test_null_date_never_matches(spark):
    frame = spark.createDataFrame([(1, None), (2, date(2019, 5, 1))], "id int, report_date date")
    assert [r.id for r in frame.where(Filters(date_from=date(2019, 1, 1)).predicate({"report_date": F.col("report_date")})).collect()] == [2]


def test_query_words():
    assert query_words('a "b c" or -d A a') == ["a", "b", "c", "d", "A"]
    assert len(query_words(" ".join(map(str, range(50))))) == 32


def test_websearch(spark):
    assert parse_websearch('a "b c" -d or e') == [[Item(("a",)), Item(("b", "c")), Item(("d",), True)], [Item(("e",))]]
    assert parse_websearch('"open') == [[Item(("open",))]]
    assert parse_websearch("") == []
    tokens = spark.createDataFrame([(1, 0, "b"), (1, 1, "c"), (2, 0, "c"), (2, 1, "b"), (3, 0, "a")], "chunk_id int, pos int, lexeme string")
    assert [r.chunk_id for r in match(tokens, parse_websearch('"b c"')).collect()] == [1]
    ids = tokens.select("chunk_id").distinct()
    assert [r.chunk_id for r in match(tokens, parse_websearch("-b"), ids).collect()] == [3]
    with pytest.raises(ValueError):
        match(tokens, parse_websearch("-b"))


def test_safe_name():
    assert safe_name("a.b.pdf") == "a.b.pdf"
    for bad in ("../a.pdf", "a.txt", "", "x/y.pdf", "..\\a.pdf"):
        with pytest.raises(ValueError):
            safe_name(bad)


def test_golden_collects_all_problems():
    problems = validate_golden([{"id": "a", "type": "exact", "question": "q", "evidence": []}, {"id": "a", "type": "odd", "question": " "}])
    assert len(problems) == 5
