"""Line and exact de-duplication against plain Python, and their edge cases."""

from collections import Counter, defaultdict

from factorloom.llm import exact, lines

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_lines string, kept string"
ROWS = [
    (1, "Same\nother É", "x", None), (2, " same\t\nonce", None, "y"), (3, "SAME", None, None), (3, "SAME", None, None), (4, None, None, None),
    (5, "", None, None), (None, "same\nsame\n\n", None, None), (6, "É same", None, None), (7, "é same", None, None), (8, "w " * 60_000 + "\nsame", None, None),
]


def plain_lines(rows, least):
    keys = lambda text: [x.strip(" \t\n\x0b\x0c\r").translate(AZ) for x in (text or "").split("\n")]
    found = Counter(k for r in rows for k in set(keys(r[1])) if k)
    return [(r[0], len(keys(r[1])), "\n".join(x for x, k in zip((r[1] or "").split("\n"), keys(r[1])) if not k or found[k] < least)) for r in rows]


def test_lines_match_a_plain_version(frame):
    for least in (1, 2, 3, 6, 99):
        out = lines.dedup_lines(frame(ROWS, DOCS), "doc_id", "text", least)
        assert out.columns[:4] == ["doc_id", "text", "n_lines", "kept"]
        got = [(r["doc_id"], r["n_lines_"], r["kept_text"]) for r in out.collect()]
        assert Counter(got) == Counter(plain_lines(ROWS, least))


def test_lines_of_an_empty_table(frame):
    assert lines.dedup_lines(frame([], DOCS), "doc_id", "text").collect() == []


def test_exact_groups(frame):
    out = exact.refine(frame(ROWS, DOCS), "doc_id", "text")
    got = {(r["doc_id"], r["text"]): (r["keep_id"], r["group_size"], r["kept_"]) for r in out.collect()}
    assert got[(3, "SAME")] == (3, 2, True)
    assert got[(4, None)] == (5, 2, False) and got[(5, "")] == (5, 2, True)
    assert got[(6, "É same")] == (6, 1, True) and got[(7, "é same")] == (7, 1, True)
    assert got[(None, "same\nsame\n\n")] == (None, 1, True)
    assert out.count() == len(ROWS)


def test_exact_null_keys(frame):
    rows = [(None, "a"), (None, "A"), (1, "b"), (None, "B")]
    got = [(r["doc_id"], r["text"], r["keep_id"], r["kept"]) for r in exact.refine(frame(rows, "doc_id long, text string"), "doc_id", "text").collect()]
    assert Counter(got) == Counter([(None, "a", None, True), (None, "A", None, True), (1, "b", 1, True), (None, "B", 1, False)])


def test_one_row_per_text_stays(frame):
    kept = exact.drop_copies(frame(ROWS, DOCS), "doc_id", "text").collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[(r[1] or "").translate(AZ)].append(r[0])
    assert Counter((r["text"] or "").translate(AZ) for r in kept) == Counter(groups.keys())
    assert exact.drop_copies(frame([], DOCS), "doc_id", "text").collect() == []


def test_prefix_collisions_are_told_apart(frame):
    rows = [(i, "p" * 200 + str(i % 3)) for i in range(9)]
    got = {r["doc_id"]: r["keep_id"] for r in exact.refine(frame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {i: 6 + i % 3 for i in range(9)}
