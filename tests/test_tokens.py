from pyspark.sql import functions as F

from tessera.functions import tokens as T

CASES = {
    "someSimpleTest1": ["some", "simple", "test", "1"], "SOME_WEIRD_NAME": ["some", "weird", "name"], "ThisASTIsBlue": ["this", "ast", "is", "blue"], "": [], "str0": ["str", "0"],
    "a.b_C": ["a", "b", "c"], "ABCd": ["ab", "cd"], "HTTP2Server": ["http", "2", "server"], "x2y": ["x", "2", "y"], "IPv4Addr": ["i", "pv", "4", "addr"], "__a__": ["a"],
    "XMLHttpRequest": ["xml", "http", "request"], "Customer#000000001": ["customer#", "000000001"], "red widget": ["red widget"],
}


def _run(spark, column, names):
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", column.alias("t")).collect()
    return {r["name"]: r["t"] for r in rows}


def test_subtokens(spark):
    assert _run(spark, T.subtokens("name"), CASES) == CASES


def test_grams(spark):
    assert _run(spark, T.characters("name"), ["aB1"]) == {"aB1": ["a", "b", "1"]}
    assert _run(spark, T.character_bigrams("name"), ["", "a", "abc"]) == {"": [""], "a": [], "abc": ["ab", "bc"]}
    assert _run(spark, T.subtoken_bigrams("name"), ["abC_d"]) == {"abC_d": ["ab"]}
    assert _run(spark, T.subtoken_trigrams("name"), ["abcdEf"]) == {"abcdEf": ["abc", "bcd", "ef"]}
    assert _run(spark, T.subtokens_and_trigrams("name"), ["abcd"]) == {"abcd": ["abcd", "abc", "bcd"]}
    assert _run(spark, T.subtokens("name"), [None]) == {None: None}


def test_strings(spark):
    row = spark.range(1).select(
        T.dot_escape(F.lit('a"b\\c\n^d')).alias("e"), T.link("http://x/", 5, F.lit("/rootA\\b.cs"), F.lit(4)).alias("l"),
        T.display(F.lit("const"), F.lit(""), F.lit("3"), F.lit("int")).alias("d"), T.dot_label(F.lit("methodReturn"), F.lit("f"), F.lit(None).cast("string"), F.lit("int")).alias("m"),
    ).first()
    assert tuple(row) == ("a''b\\\\c  d", "http://x/A/b.cs#L5", "const:3 : int", "*f")
