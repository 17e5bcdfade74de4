from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.splitting import _TOKEN, pieces_of, split_oversized


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n\xa0! ", max_size=300), st.integers(1, 12), st.integers(0, 14))
def test_pieces(text, target, overlap):
    out = pieces_of(text, target, overlap)
    tokens = _TOKEN.findall(text)
    back = min(overlap, target - 1)
    whole, at = "", 0
    for k, (a, b, o, piece) in enumerate(out):
        assert len(_TOKEN.findall(piece)) == b - a <= target
        assert _TOKEN.findall(piece) == tokens[a:b]
        assert a + o == at and o == (min(back, at) if k else 0)
        spans = [m.start() for m in _TOKEN.finditer(piece)]
        whole += piece[spans[o]:] if k else piece
        at = b
    assert whole == text and at == len(tokens) and (len(out) == 1) == (len(tokens) <= target)


def test_cuts_at_the_paragraph():
    text = "one two three. four five six\n\nseven eight nine ten"
    assert [p[3] for p in pieces_of(text, 8, 0)] == ["one two three. four five six\n\n", "seven eight nine ten"]


def test_rows(spark):
    options = spark.createDataFrame([("a", 3, 1), ("a", 5, 2), ("b", None, 1), ("c", 2, None)], "source string, target_tokens int, overlap_tokens int")
    rows = [(1, "a", "w w w", 7), (2, "a", "w w\xa0w w w", 7), (2, "a", "w w w w", 7), (3, "b", "w " * 99, 7), (4, None, "w " * 99, 7), (5, "c", "x y z", 7), (6, "zz", "w " * 99, 7), (7, "a", None, 7), (8, "a", "", 7), (9, "a", "q " * 50_000, 7)]
    df = spark.createDataFrame(rows, "id int, source string, text string, target int")
    out = split_oversized(df, "t", "id", options, "id", "id").collect()
    assert {r["row_id"] for r in out} == {2, 5, 9}
    assert max(r["piece_no"] for r in out if r["row_id"] == 9) == next(r["n_pieces"] for r in out if r["row_id"] == 9) >= 25_000
    assert sum(r["piece_no"] == 1 for r in out) == 4
    assert split_oversized(df.limit(0), "t", "id", options, "id", "id").count() == 0
