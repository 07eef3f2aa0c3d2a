import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcorpus.llm.pieces import cut, pieces, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,å日。é‍👩", max_size=400), st.integers(2, 60), st.integers(0, 20))
def test_limits(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = cut(text, limit, overlap)
    assert not got == bool(text)
    for lo, hi in got:
        assert 0 < hi - lo <= limit
    for (a, b), (c, d) in zip(got, got[1:]):
        assert c == b - overlap and d > b
    if text:
        assert got[0][0] == 0 and got[-1][1] == len(text)


def test_natural_places():
    text = ("Et afsnit med tekst. " * 12).strip() + "\n\n" + ("Et andet afsnit. " * 14).strip()
    (a, b), (c, d) = cut(text, 300, 0)
    assert text[:b].endswith("\n\n") and d == len(text)
    got = cut("ord " * 1000, 700, 70)
    sizes = [hi - lo for lo, hi in got]
    assert max(sizes) - min(sizes) < 30 and len(got) == -(-(4000 - 70) // 630)
    assert cut("", 10, 2) == [] and cut("kort", 10, 2) == [(0, 4)]
    with pytest.raises(ValueError):
        cut("x", 5, 5)


def test_rows(spark):
    rows = [(1, "x" * 25, "c"), (2, None, "c"), (3, "", "c"), (4, "y" * 10, "c"), (1, "x" * 25, "c")]
    df = spark.createDataFrame(rows, "id long, t string, cuts string")
    done = split_oversized(df, "t", 10, 2)
    assert [r["id"] for r in done.collect()] == [1, 1]
    got = pieces(done).collect()
    assert all(r["piece_text"] == "x" * (r["end_char"] - r["start_char"]) for r in got)
    assert [set(r["cuts"][0].asDict()) for r in split_oversized(df, "t", 10, 2, with_text=False).collect()] == [{"start", "end"}] * 2
    assert len(got) == 6 and max(len(r["piece_text"]) for r in got) <= 10 and {r["chunk_sequence_id"] for r in got} == {0, 1, 2}
    assert split_oversized(df.where("false"), "t", 10, 2).count() == 0
