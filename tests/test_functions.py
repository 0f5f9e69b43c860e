import math

import pytest
from pyspark.sql import functions as F

from aletheia.functions import text as T
from aletheia.functions import vectors as V


def test_canonical_source(spark):
    df = spark.createDataFrame(
        [("src0_train",), ("latest_x",), ("train",), ("src_3",), (None,), ("a_dev_b",), ("plain",)], "s string"
    )
    got = [r[0] for r in df.select(T.canonical_source("s")).collect()]
    assert got == ["src0", "latest", "train", "src_3", None, "a", "plain"]


def test_label_binary_no_strip(spark):
    df = spark.createDataFrame([("True",), ("TRUE",), (" True ",), ("false",), (None,)], "l string")
    assert [r[0] for r in df.select(T.label_binary("l")).collect()] == [1, 1, 0, 0, None]


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([("\t a b \n",), ("",), (None,), (" x ",)], "s string")
    assert [r[0] for r in df.select(T.strip_ws("s")).collect()] == ["a b", "", None, "x"]


def test_generation_and_judge_prompt(spark):
    df = spark.createDataFrame([("What is 2+2", " Four ", "  FOUR\n")], "q string, a string, g string")
    r = df.select(T.generation_prompt("q").alias("p"), T.judge_prompt("a", "g").alias("j")).first()
    assert r.p == "What is 2+2. Provide a single concise answer and write nothing else.\nAnswer: **"
    assert r.j.startswith("\nGround Truth Answer: four\nGenerated Answer: four\n\nDoes the generated")
    assert "ground truth answer? \n- Ignore" in r.j and r.j.endswith("'True' or 'False'.\n")


def test_echo_answer_literal_delimiter(spark):
    p = "Is a.b (c)** \\Q ok. Provide a single concise answer and write nothing else.\nAnswer: **"
    df = spark.createDataFrame([(p + "yes", p), ("no prompt here", p), (None, p)], "d string, p string")
    assert [r[0] for r in df.select(T.echo_answer("d", "p")).collect()] == ["yes", None, None]


def test_json_content(spark):
    df = spark.createDataFrame([('{"choices":[{"message":{"content":"  True \\n"}}]}',), ("not json",)], "j string")
    assert [r[0] for r in df.select(T.json_content("j")).collect()] == ["True", None]


def test_pool_methods(spark):
    hs = [[1.0, 5.0], [3.0, 2.0], [2.0, 9.0], [100.0, 100.0]]
    df = spark.createDataFrame([(hs,), ([[4.0, 1.0]],)], "h array<array<double>>")
    mx = [r[0] for r in df.select(V.pool("h", "max", 3)).collect()]
    mean = [r[0] for r in df.select(V.pool("h", "mean", 3)).collect()]
    first = [r[0] for r in df.select(V.pool("h", "first", 3)).collect()]
    one = [r[0] for r in df.select(V.pool("h", "max", 1)).collect()]
    assert mx == [[3.0, 9.0], [4.0, 1.0]]
    assert mean == [[2.0, 16.0 / 3], [4.0, 1.0]]
    assert first == [[1.0, 5.0], [4.0, 1.0]]
    assert one == [[1.0, 5.0], [4.0, 1.0]]


def test_pool_nan_propagates(spark):
    df = spark.createDataFrame([([[float("nan"), 1.0], [0.0, 2.0]],)], "h array<array<double>>")
    mx, mean = df.select(V.pool("h", "max"), V.pool("h", "mean")).first()
    assert math.isnan(mx[0]) and mx[1] == 2.0 and math.isnan(mean[0])


def test_pool_errors(spark):
    with pytest.raises(ValueError):
        V.pool("h", "median")
    empty = spark.createDataFrame([([],)], "h array<array<double>>")
    ragged = spark.createDataFrame([([[1.0, 2.0], [3.0]],)], "h array<array<double>>")
    for df in (empty, ragged):
        with pytest.raises(Exception):
            df.select(V.pool("h", "max")).collect()
        assert df.select(V.pool("h", "max", strict=False)).first()[0] is None


def test_cosine_and_sigmoid(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    cos = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert cos[0] == pytest.approx(1 / math.sqrt(2)) and cos[1] == 0.0
    s = spark.range(1).select(V.sigmoid(F.lit(0.0)), V.softmax2_class1(F.lit(1.0), F.lit(3.0))).first()
    assert s[0] == 0.5 and s[1] == pytest.approx(1 / (1 + math.exp(-2)))
