from pyspark.sql import functions as F

from veilspark import model as M
from veilspark.functions import prepare as P
from veilspark.functions import scalars as S

CODE = ["16D", "1L", "37D", "Em_Foo", "a=b", "x]y", "{ }", "7-410", "N", "Group\\ABC-Z", "LSMonito(", ")Monitor", "東芝（", "情報.", "Sony."]
NAMES = ["田中", "ニコン", "IBM", "Sony", "Smith", "横浜市", '"Sony (Japan)"', "会社（日本）", "Booking.com", "L'Oréal"]


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_code_like(spark):
    assert values(spark, CODE, S.looks_like_code(F.col("x"))) == [True] * len(CODE)
    assert values(spark, NAMES, S.looks_like_code(F.col("x"))) == [False] * len(NAMES)


def test_nonperson_latin_and_caps(spark):
    rows = ["EndTime", "theta", "FIARSL", "Wafer ID", "John", "Anne-Marie", "佐伯", "123"]
    assert values(spark, rows, S.looks_like_nonperson_latin(F.col("x"))) == [True, True, True, True, False, False, False, False]
    assert values(spark, ["WEXPC-YCD", "Ibm", "社A", "12"], S.is_jargon_caps(F.col("x"))) == [True, False, False, False]


def test_normalisers(spark):
    assert values(spark, ["ＳＯＮＹ　ビル", "Straße", None], S.normalize("x")) == ["sonyビル", "strasse", None]
    assert values(spark, ["Ｓｔｓ x"], S.normalize_case_kept("x")) == ["Stsx"]


def test_vote_categories(spark):
    rows = [("dict", "社名(辞書)"), ("session", "人名(確認済)"), ("regex", "連絡先"), ("llm", "Department"), ("llm", "Other"), ("sudachi", "名詞-固有名詞-人名-姓"), ("sudachi", "名詞-普通名詞"), ("ja_ginza", "Company_Group"), ("ja_ginza", "Show_Organization")]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, l string").select(S.vote_category(F.col("c"), F.col("l"))).collect()]
    assert got == ["社名", "人名", "連絡先", "社名", None, "人名", None, "社名", None]


def test_levels():
    assert S.levels_at_or_above("strong") == ["確定", "強"]
    assert S.levels_at_or_above("faint") == ["確定", "強", "中", "弱", "微弱"]
    try:
        S.levels_at_or_above("loud")
    except ValueError:
        pass
    else:
        raise AssertionError


def test_wire_round_trip(spark):
    levels = list(M.CONFIDENCE_RANK)
    assert values(spark, levels, S.from_wire(S.to_wire(F.col("x")))) == levels
    assert values(spark, ["other"], S.to_wire(F.col("x"))) == ["other"]


def test_hash_and_snippets(spark):
    import hashlib

    assert spark.createDataFrame([(["a", "b"],)], "x array<string>").select(S.content_hash(F.col("x"))).first()[0] == hashlib.sha256(b"a\0b\0").hexdigest()
    snippet = spark.createDataFrame([("x" * 30 + "KEY" + "y" * 30,)], "x string").select(S.context_snippet(F.col("x"), F.lit(30), F.lit(33))).first()[0]
    assert snippet == "…" + "x" * 20 + "《KEY》" + "y" * 20 + "…"


def test_subwords(spark):
    assert values(spark, ["HTTPServer", "SmashMark2", "社A"], S.subwords(F.col("x"))) == [["HTTP", "Server"], ["Smash", "Mark", "2"], ["A"]]


def test_tables_and_brackets_agree_with_kernels(spark):
    rows = ["| 名前 | 所属 |\n| --- | --- |\n| 田中 | 営業 |", "a|b", "||", "plain", "", "x\n|--|\n"]
    assert values(spark, rows, P.flatten_tables(F.col("x"))) == [P._flatten_with_map(x)[0] for x in rows]
    rows = ["姓A(社B)", ")(", "a)(b", "( x )y", "(((", "（株）アルファ"]
    assert values(spark, rows, P.pad_brackets(F.col("x"))) == [P._pad_with_map(x)[0] for x in rows]


def test_body_maps_back():
    for chunks in (["第一章", "第二章"], ["姓A(社B)"], ["| 名前 | 所属 |\n| --- | --- |\n| 田中 | 営業 |", " ", "x(y)z"], []):
        text, original, where = P.build_body(chunks)
        assert len(text) == len(where)
        assert all(j == -1 or text[i] == original[j] for i, j in enumerate(where))


def test_windows(spark):
    def cut(text, size, overlap=0):
        return [(w["start"], w["end"]) for w in spark.createDataFrame([(text,)], "x string").select(P.windows(F.col("x"), size, overlap)).first()[0]]

    assert cut("あ\n\nい\n\nう\n\nえ", 2) == [(0, 4), (6, 10)]
    assert cut("aaaa\n\n\n\nb", 2) == [(0, 4), (8, 9)]
    assert cut("", 2) == []
    assert cut("aa\n\nbb\n\ncc", 2, 1) == [(0, 2), (0, 6), (4, 10)]


def test_back_projection(spark):
    d = spark.createDataFrame([(0, 2, [0, -1, 5]), (1, 2, [0, -1, 5])], "a int, b int, m array<int>")
    assert [r[0] and tuple(r[0]) for r in d.select(P.back_project(F.col("a"), F.col("b"), F.col("m"))).collect()] == [(0, 1), None]


def test_splitters():
    text = "一文目。二文目です。" * 20
    parts = P.recursive_split(text, P.DEFAULT_SEPARATORS, 30, 0)
    assert "".join(parts) == text and max(map(len, parts)) <= 30
    assert [t for t, _ in P.markdown_sections("# A\nx\n## B\ny\n# C\nz", 800)] == ["# A\nx\n\n## B\ny\n\n# C\nz"]
