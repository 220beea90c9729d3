"""Splitting: exact round trips, limits, overlaps, long lines, edges."""

from hypothesis import given, settings
from hypothesis import strategies as st

from driftnet.llm import splitting


def rebuilt(pieces):
    out = ""
    for piece, _, _, own, _ in pieces:
        out += "".join(splitting._lines_with_ends(piece)[own - 1:]) if own else piece
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é日\t", max_size=30), max_size=40), st.sampled_from(["\n", "\r\n"]), st.booleans(), st.integers(8, 90), st.integers(0, 6))
def test_round_trip(lines, end, last, limit, overlap):
    text = end.join(lines) + (end if last else "")
    pieces = splitting.split_text(text, limit, overlap)
    assert rebuilt(pieces) == text
    raw = text.encode()
    for piece, line, byte, own, _ in pieces:
        assert len(piece.encode()) <= limit
        assert raw[byte:byte + len(piece.encode())] == piece.encode()
        assert text.count("\n", 0, len(raw[:byte].decode())) == line
        assert own <= overlap + 1


def test_overlap_is_repeated():
    text = "".join(f"line {i}\n" for i in range(100))
    pieces = splitting.split_text(text, 200, 3)
    for before, after in zip(pieces, pieces[1:], strict=False):
        assert splitting._lines_with_ends(after[0])[:3] == splitting._lines_with_ends(before[0])[-3:] and after[3] == 4


def test_cuts_at_the_valley():
    apples = [f"apple orchard harvest basket {i}" for i in range(20)]
    ships = [f"harbour vessel anchor captain {i}" for i in range(20)]
    text = "\n".join(apples + ships)
    pieces = splitting.split_text(text, len("\n".join(apples)) + 200, 0)
    assert pieces[1][1] == 20


def test_operator(spark):
    long = "x" * 50
    rows = [(1, f"ab\n{long}\ncd\n", "Text/X; charset=u", 10, 100, 0, "e"), (1, f"ab\n{long}\ncd\n", "Text/X; charset=u", 10, 100, 0, "e"), (2, "short", "text/x", 0, 0, 0, "e"), (3, None, "text/x", 0, 0, 0, "e"),
            (None, long, "text/x", 0, 0, 0, "e"), (4, "y" * 30 + "\n" + "z" * 10, None, None, None, None, "e"), (5, "", "text/x", 0, 0, 0, "e"), (6, "a\n" * 30, "text/x", 5, 7, 3, "e")]
    blobs = spark.createDataFrame(rows, "blob_id long, text string, media_type string, line_offset int, byte_offset long, commit_line int, max_bytes string")
    limits = spark.createDataFrame([("text/x", 20, 1), ("*", 35, 2), (None, 1, 1)], "media_type string, max_bytes int, overlap_lines int")
    got = splitting.pieces(blobs, limits).collect()
    assert {r["blob_id"] for r in got} == {1, 4, 6}
    assert {(r["blob_id"], r["long_line"]) for r in got if r["long_line"]} == {(1, 2)}
    one = sorted((r for r in got if r["blob_id"] == 1), key=lambda r: r["piece_no"])
    assert one[0]["line_offset"] == 10 and one[0]["byte_offset"] == 100 and one[-1]["line_offset"] == 12
    six = sorted((r for r in got if r["blob_id"] == 6), key=lambda r: r["piece_no"])
    assert six[0]["commit_line"] == 3 and all(r["n_pieces"] == len(six) for r in six)
    assert splitting.pieces(blobs.limit(0), limits).count() == 0 and splitting.pieces(blobs, limits.limit(0)).count() == 0


def test_very_long_text():
    assert rebuilt(splitting.split_text("word " * 200_000, 4096, 2)) == "word " * 200_000
