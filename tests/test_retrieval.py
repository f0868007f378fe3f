"""Many questions at once against one question at a time."""

import random

import pytest

from codestrata.operators import retrieval
from codestrata.plans.api import Repository

CHUNK = "path string, start_line int, id string, content string, embedding array<double>, symbol_name string, symbol_kind string, extra int"
QUESTION = "question_id int, query string, vector array<double>"


def tables(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    vector = lambda: [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]
    rows = [(f"d{k % 13}/f.py", k, f"c{k}", " ".join(rng.choices(words, k=4)), vector(), rng.choice([None, "w3"]), None, k) for k in range(60)]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0]]
    rows += [("odd/f.py", k, f"o{k}", None if k == 2 else "w1 w2", v, None, None, k) for k, v in enumerate(odd)]
    rows += [("tie/f.py", 1, f"t{k}", "w5 w6", [1.0, 0.0, 0.0], None, None, k) for k in range(8)] + [(None, 1, "lost", "w1", [1.0, 1.0, 1.0], None, None, 0)]
    near = [(f"d{k}/f.py", f"d{(k * 3 + 1) % 13}/f.py") for k in range(13) if k != (k * 3 + 1) % 13] + [("odd/f.py", "d1/f.py"), ("d1/f.py", "gone/f.py")]
    asked = [(k, " ".join(rng.choices([*words, "none", "Py"], k=3)), vector()) for k in range(12)]
    asked += [(20, "nothing here at all", [1.0, 0.0, 0.0]), (21, "問", [1.0, 1.0, 1.0]), (22, "zz", None), (23, "w1", [1.0, 2.0]), (24, "w5 w6", [1.0, 0.0, 0.0]), (25, asked[0][1], asked[0][2]), (26, "d2", [1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, CHUNK), asked, spark.createDataFrame(near, "path string, related string")


@pytest.mark.parametrize("small", [False, True])
def test_many_questions_as_one_by_one(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 5)
        monkeypatch.setattr(retrieval, "CELLS", 16)
        monkeypatch.setattr(retrieval, "FREQUENT", 3)
        monkeypatch.setattr(retrieval, "MOST_PATHS", 2)
    c, asked, near = tables(spark)
    got = {}
    many = retrieval.retrieve_many(c, spark.createDataFrame([*asked, (30, "  ", [1.0]), (31, None, None)], QUESTION), near, 12)
    for r in many.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.id, round(r.vector_score, 9), round(r.keyword_score, 9), r.graph_score, tuple(r.related_paths), round(r.score, 9)))
    assert set(got) == {q for q, _, _ in asked} and got[25] == got[0]
    assert {s for rows in got.values() for _, _, _, s, _, _ in rows} == {0.0, 0.5, 1.0}
    for q, text, vector in asked if small else asked[-7:]:
        one = retrieval.retrieve(c, text, vector or [], near, 12).collect()
        assert got[q] == [(r.id, round(r.vector_score, 9), round(r.keyword_score, 9), r.graph_score, tuple(r.related_paths), round(r.score, 9)) for r in one], (q, text)


def test_nothing_to_ask_or_find(spark):
    c, asked, near = tables(spark)
    questions = spark.createDataFrame(asked, QUESTION)
    assert retrieval.retrieve_many(c, questions.limit(0), near).columns == retrieval.retrieve_many(c, questions, None).columns
    assert retrieval.retrieve_many(c.limit(0), questions, near).isEmpty()
    with pytest.raises(ValueError, match="positive"):
        retrieval.retrieve_many(c, questions, near, 0)


def test_repository_answers_many(spark):
    repo = Repository.of(spark, [("app/auth.py", "def token():\n    return user"), ("app/main.py", "import app.auth\ndef handler():\n    return 1")])
    questions = spark.createDataFrame([(1, "token"), (2, "handler main"), (3, "  ")], "question_id int, query string")
    got = repo.retrieve_many(questions, 2).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.rank) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    for q, text in ((1, "token"), (2, "handler main")):
        assert [r.id for r in got if r.question_id == q] == [r.id for r in repo.retrieve(text, 2).collect()]
