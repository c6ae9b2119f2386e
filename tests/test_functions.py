from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_lexical_tokens(spark):
    assert one(spark, T.lexical_tokens(F.col("t")), t="Hello, World! 2024-Q3.") == ["hello", "world", "2024", "q3"]
    assert one(spark, T.lexical_tokens(F.col("t")), t="A B ab cd") == ["ab", "cd"]
    assert one(spark, T.lexical_tokens(F.lit(None).cast("string"))) is None


def test_word_count_of_blank_and_null(spark):
    assert one(spark, T.word_count(F.col("t")), t=" \n\t ") == 0
    assert one(spark, T.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, T.word_count(F.col("t")), t=" a  b\nc ") == 3


def test_timestamp_label(spark):
    assert one(spark, T.timestamp_label(F.lit(65.9))) == "01:05"
    assert one(spark, T.timestamp_label(F.lit(3725.0))) == "01:02:05"
    assert one(spark, T.timestamp_label(F.lit(3725.0), hours=False)) == "62:05"


def test_hints_leave_out_what_is_not_named(spark):
    got = one(spark, T.metadata_hints(F.col("t")), t="where is parse_config in app/core/loader.py of the python file")
    assert got == {"file_name": "loader.py", "language": "python", "symbol_name": "parse_config"}
    assert one(spark, T.metadata_hints(F.col("t")), t="how does GitHub work") == {}


def test_clamp(spark):
    assert one(spark, T.clamp(F.lit("1.7"))) == 1.0
    assert one(spark, T.clamp(F.lit("-3"))) == 0.0
    assert one(spark, T.clamp(F.lit("nonsense"))) is None
    assert one(spark, T.clamp(F.lit("NaN"), 0.5)) == 0.5


def test_context_dependent(spark):
    d = lambda q, h: one(spark, T.context_dependent(F.col("q"), F.lit(h)), q=q)
    assert d("does it also work for the other registry that we configured", True)
    assert d("and that one?", True)
    assert not d("and that one?", False)
    assert not d("which registry publishes downstream uploads after the archive was called", True)


def test_code_forms_need_three(spark):
    assert one(spark, T.looks_like_code(F.col("t")), t="const a = function() { return 1; }")
    assert not one(spark, T.looks_like_code(F.col("t")), t="the class returned")
    assert not one(spark, T.looks_like_code(F.lit(None).cast("string")))


def test_strip_fence_and_readings(spark):
    assert one(spark, T.strip_fence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.combine_readings(F.lit(""), F.lit("x"))) == "x"
    assert "[Vision description]" in one(spark, T.combine_readings(F.lit("a"), F.lit("b")))


def test_pipe_row_escapes(spark):
    assert one(spark, T.pipe_row(F.lit(" a|b\nc "), F.lit(None).cast("string"))) == "| a\\|b c |  |"


def test_cosine_and_overlap(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("z")).alias("zero"), V.dot(F.col("a"), F.col("b")).alias("dot")).first()
    assert r["zero"] == 0.0 and r["dot"] == 1.0
    s = spark.createDataFrame([(["a", "b", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>")
    r = s.select(V.overlap(F.col("a"), F.col("b")).alias("x"), V.overlap(F.col("a"), F.col("e")).alias("y")).first()
    assert r["x"] == 0.5 and r["y"] == 0.0
