import hashlib
import math
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import vector


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n", "\n\n", "a\x0bb\x0cc\x1cd\x85e\u2028f"])
def test_lines(spark, text):
    assert one(spark, X.lines("t"), t=text) == text.splitlines()


def test_tokens_and_shingles(spark):
    text = "The Quick\u00a0brown\tfox\x1c jumps over\nthe lazy dog"
    assert one(spark, X.tokens("t"), t=text) == text.lower().split()
    words = text.lower().split()
    assert sorted(one(spark, X.shingles("t"), t=text)) == sorted({" ".join(words[i : i + 5]) for i in range(len(words) - 4)})
    assert one(spark, X.shingles("t"), t="a b") == ["a b _ _ _"]
    assert one(spark, X.shingles("t"), t="") == ["_ _ _ _ _"]


def test_ratio_counts_code_points_and_the_bound_is_kept(spark):
    assert one(spark, X.non_ascii_ratio("t"), t="éabcd") == 0.2
    assert one(spark, X.non_ascii_ratio("t"), t="") == 0.0
    assert one(spark, X.non_ascii_ratio("t"), t="🙂") == 1.0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.text("abc", max_size=8), b=st.text("abc", max_size=8))
def test_overlap(spark, a, b):
    n = max(i for i in range(min(len(a), len(b)) + 1) if i == 0 or a[-i:] == b[:i])
    assert one(spark, X.without_overlap("a", "b"), a=a, b=b) == b[n:]


def test_prefix_trim_tokens(spark):
    assert one(spark, X.task_prefixed("t", F.lit("x")), t="go") == "[TASK: x]\ngo"
    assert one(spark, X.task_prefixed("t", F.lit("x")), t="[TASK: x]\ngo") == "[TASK: x]\ngo"
    assert one(spark, X.task_prefixed("t", F.lit("x")), t="") == "[TASK: x]"
    assert one(spark, X.trimmed("t", 4), t="abc def") == "abc\n...[trimmed]"
    assert one(spark, X.token_estimate("t"), t="") == 0
    assert one(spark, X.token_estimate("t"), t="abcdefgh") == math.ceil(8 / 3.5)
    assert one(spark, X.token_budget("n", 1000), n=990) == 256
    assert one(spark, X.human_bytes("n"), n=1536) == "1.50 KB"


def test_code_span(spark):
    text = "see\n```js\nlet a;\n```\n```py\nx = 1\n```"
    assert one(spark, X.code_span("t", "python"), t=text) == "x = 1\n"
    assert one(spark, X.code_span("t", "java"), t=text) == "let a;\n"
    assert one(spark, X.code_span("t", "python"), t="well, def f(): pass") == "def f(): pass"
    assert one(spark, X.code_span("t", "python"), t="nothing") == "nothing"


def test_repo_key(spark):
    assert one(spark, X.repo_key("r", "i"), r=" a/b ", i="7") == "a/b"
    assert one(spark, X.repo_key("r", "i"), r="Unknown", i="7") == "pseudo-" + hashlib.sha1(b"7").hexdigest()[:12]


def expected_embedding(text, dim):
    v = [0.0] * dim
    for w in text.lower().split():
        d = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(d[:4], "big") % dim] += 1.0 if d[4] % 2 == 0 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


@pytest.mark.parametrize("text", ["", "alpha beta Alpha\ngamma", "één twee"])
def test_hash_embedding(spark, text):
    assert one(spark, vector.hash_embedding("t", 32), t=text) == pytest.approx(expected_embedding(text, 32))


def test_point_id(spark):
    assert one(spark, vector.point_id("a", "b"), a="p", b="x/y.py") == str(uuid.uuid5(uuid.NAMESPACE_URL, "p|x/y.py"))


def test_search_respects_filter_and_ties(spark):
    points = spark.createDataFrame([(3, "a", [1.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "b", [1.0, 0.0]), (4, "a", [0.0, 0.0])], "id int, project string, vector array<double>")
    assert [r["id"] for r in vector.search(points, [1.0, 0.0], 3, where={"project": "a"}).collect()] == [1, 3, 4]
