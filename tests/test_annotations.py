import math

from hypothesis import given, settings
from hypothesis import strategies as st

from rankfile import functions as C
from rankfile.operators.annotate import fold, parse_comment

CASES = [
    "", " ", "plain", " a comment ", "[%eval 0.5]", "[%eval -12.25] x", "[%eval +3]", "[%eval #4]", "[%eval #-3] [%eval 1.0]", "[%eval #+3]", "[%eval #99999999999]", "[%eval ]", "[%eval x]", "[%eval 1.]", "[%eval 1.5 ]",
    "[%eval\n2.5]", "[%eval\t\f\r -1]", "[%clk 1:2:3]", "[%clk 0:09:36.2]", "[%clk 1:255:0]", "[%clk 1:256:0]", "[%clk 4294967295:0:0]", "[%clk 4294967296:0:0]", "[%clk 12]", "[%clk 1:2]", "[%clk 1:2:3.]",
    "[%note 7] tail", "a [%clk 0:0:1] b", "[%]", "t [%] rest", "x [", "[abc] q", "t [%eval 0.5", "a [b] [%eval 1] [c", "[%eval 1][%clk 0:1:0]text[%eval #2]", "[%eval #2] [%eval #-5]", " ", "café [%eval 0.1]", "[[%eval 1]]", "%eval 1", "[% eval 1]",
]


def both(spark, comments):
    rows = spark.createDataFrame(list(enumerate(comments)), "k long, c string")
    c = C.annotation_items
    from pyspark.sql import functions as F

    col = F.col("c")
    one = rows.select("k", C.annotation(col).alias("a")).orderBy("k").select("a.*").collect()
    apart = rows.select("k", C.comment_eval(col).alias("eval"), C.comment_clock(col).alias("clock"), C.comment_text(col).alias("text"), c(col).alias("items")).orderBy("k").collect()
    assert [tuple(r) for r in one] == [tuple(r)[1:] for r in apart]
    return rows.select("k", c(col).alias("items"), C.comment_eval(col).alias("eval"), C.comment_clock(col).alias("clock"), C.comment_text(col).alias("text")).orderBy("k").collect()


def check(spark, comments):
    import numpy as np

    for comment, row in zip(comments, both(spark, comments)):
        note = fold(comment)
        assert [tuple(i) for i in row["items"]] == [tuple(i) for i in parse_comment(comment)], comment
        assert row["text"] == note.text, comment
        assert row["eval"] == (None if note.eval is None else float(np.float32(note.eval))), comment
        if note.clock is None:
            assert row["clock"] is None
        else:
            h, m, s = map(np.float32, note.clock)
            assert math.isclose(row["clock"], float(h * np.float32(3600) + m * np.float32(60) + s), rel_tol=0, abs_tol=0), comment


def test_native_functions_equal_the_kernel(spark):
    check(spark, CASES)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["[%", "]", "[", "eval", "clk", " ", "\n", "#", "-", "1", "23", ":", ".", "0.5", "1:2:3", "text", "[%eval 1.5]", "[%clk 0:0:9]"]), max_size=12).map("".join), min_size=60, max_size=60))
def test_native_functions_equal_the_kernel_on_noise(spark, comments):
    check(spark, comments)


def test_fold():
    assert fold("[%eval #3] mate soon").text == "[Mate 3]  mate soon"
    assert fold("soon [%eval #-3]").text == "soon [Mate -3]"
    assert fold("a [%clk 0:0:1] b").text == "a   b"
    assert fold("[%eval 0.19]") == ("", 0.19, None)


def test_header_functions(spark):
    from pyspark.sql import functions as F

    many = "".join(f'[K{i % 700} "{i}"]\n' for i in range(5000)) + "\n1. e4 *"
    texts = ['[A "1"]\n[b "2"]\n[A "3"]\n\n1. e4 1-0', "1. e4", "", None, '[X "y"]', many]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    t = F.col("t")
    got = rows.select("k", C.header(t, "a").alias("a"), C.header_map(t).alias("m"), C.termination(t).alias("o")).orderBy("k").collect()
    assert [r["a"] for r in got] == ["1", None, None, None, None, None]
    assert [r["m"] for r in got][:5] == [{"A": "3", "b": "2"}, {}, {}, None, {"X": "y"}]
    assert got[5]["m"] == {f"K{i}": str(i + 4200 if i + 4200 >= 4300 else i + 4900) for i in range(700)}
    assert [r["o"] for r in got] == ["White", None, None, None, None, "Unknown"]


def test_escaped_lines_are_no_moves():
    from rankfile.operators.lex import read_game

    g = read_game('%first\n[A "b"]\n% between\n[C "d"]\n\n%note d4 h6\n1. e4 e5\n%note d4 h6\n2. Nf3 {x\n%kept} *')
    assert g.tags == [("A", "b"), ("C", "d")] and g.sans == ["e4", "e5", "Nf3"] and g.comments == [(3, "x\n%kept")] and g.outcome == "Unknown"
    assert read_game("1. e4 %50 e5 *").sans == ["e4", "e5"] and read_game("1. e4 e5\n%d4 h6").sans == ["e4", "e5"]
