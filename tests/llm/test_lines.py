import random

from waymark.llm import lines as L
from waymark.llm import queries


def apart(a, b):
    """Edits between two strings, as far as one."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 1 if (a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]) else 2


def brute(rows, least=5):
    places = sorted((((d is None), d or 0, n), d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")) if len(line) >= least)
    out = []
    for i, (at, d, n, line) in enumerate(places):
        for other_at, od, on, other in places[:i]:
            edits = apart(line, other) if other_at < at else 2
            if edits < 2:
                out.append((d, n, od, on, edits))
                break
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.line_no, r.keep_doc, r.keep_line, r.edits) for r in df.collect()), key=str)


def test_against_brute_force(documents, texts):
    small = {d: t for d, t in texts.items() if d < 80}
    want = brute(list(small.items()))
    assert want and result(L.dropped_lines(documents.where("doc_id < 80"))) == want


def test_edits_of_every_kind(spark):
    rng, rows = random.Random(5), []
    for d in range(60):
        text = []
        for _ in range(6):
            base = list(rng.choice(["the quick brown fox", "aaaaaaaa", "abababab", "ünï😀cöde line", "short", "tiny"]))
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(base))
                kind = rng.randrange(3)
                base[k:k + 1] = [] if kind == 0 else [rng.choice("abxé😀")] if kind == 1 else [base[k], rng.choice("abx")]
            text.append("".join(base))
        rows.append((d, "\n".join(text)))
    want = brute(rows)
    assert {r[4] for r in want} == {0, 1}
    assert result(L.dropped_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    # repeated rows share their place
    want = brute([r for r in rows if r[0] != 1] + [rows[0]])
    assert set(result(L.dropped_lines(odd))) == set(want)
    cut = L.without_dropped(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r.text for r in cut.where("doc_id = 1").collect()} == {rows[0][1]}
    assert [r.text for r in cut.where("doc_id = 9").collect()] == [""]
    assert L.dropped_lines(none).count() == 0 and L.without_dropped(none).count() == 0


def brute_every_length(rows, least=5):
    """As brute, but equal lines of every length count; neighbours of one edit need ``least`` characters."""
    places = sorted((((d is None), d or 0, n), d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")))
    out = []
    for i, (at, d, n, line) in enumerate(places):
        for other_at, od, on, other in places[:i]:
            edits = apart(line, other) if other_at < at else 2
            if edits == 0 or (edits == 1 and min(len(line), len(other)) >= least):
                out.append((d, n, od, on, edits))
                break
    return sorted(out, key=str)


def test_short_lines_repeat(spark, tmp_path):
    rng, rows = random.Random(6), []
    for d in range(60):
        rows.append((d, "\n".join(rng.choice(["Les.", "Les", "Less.", "a", "b", "", "--", "é😀", "Home", "Homes", "Homey", "long enough", "long enouhg", "long enoug"]) for _ in range(6))))
    spark.createDataFrame([*rows, (None, "Les.\n\na"), (70, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = result(queries.QUERIES["op5_line_deletions"](spark, str(tmp_path)))
    want = brute_every_length([*rows, (None, "Les.\n\na")])
    assert {(r[4]) for r in want} == {0, 1} and got == want


def test_cut_texts_lose_short_repeats(spark):
    docs = spark.createDataFrame([(1, "Home\nA first line\nx"), (2, "Home\nA first line\ny\nx"), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in L.without_dropped(docs).collect()} == {1: "Home\nA first line\nx", 2: "y", 3: None}
    assert {r.doc_id: r.text for r in L.without_dropped(docs, least_exact=None).collect()}[2] == "Home\ny\nx"


def distance(a, b):
    """Edits between two strings, by the table of all prefixes."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def brute_within(rows, edits, least):
    places = sorted((((d is None), d or 0, n), d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")))
    out = []
    for i, (at, d, n, line) in enumerate(places):
        for other_at, od, on, other in places[:i]:
            apart_ = distance(line, other) if other_at < at else edits + 1
            if apart_ == 0 or (apart_ <= edits and min(len(line), len(other)) >= least):
                out.append((d, n, od, on, apart_))
                break
    return sorted(out, key=str)


def test_bounds_of_more_edits(spark, odd):
    rng, rows = random.Random(7), []
    for d in range(50):
        text = []
        for _ in range(4):
            base = list(rng.choice(["quick brown fox", "aaaaaaaa", "abababab", "ünï😀cöde", "short", "no", ""]))
            for _ in range(rng.randrange(5)):
                k, kind = rng.randrange(len(base) + 1), rng.randrange(3)
                base[k:k + (kind != 1)] = [] if kind == 0 else [rng.choice("abxé😀")]
            text.append("".join(base))
        rows.append((d, "\n".join(text)))
    rows += [(None, "short\nshirt\nshy"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for edits, least in ((1, 5), (2, 5), (2, 1), (3, 4)):
        want = brute_within(rows, edits, least)
        assert {r[4] for r in want} == set(range(edits + 1))
        assert result(L.dropped_lines(docs, least, 0, edits)) == want, (edits, least)
    cut = L.without_dropped(spark.createDataFrame([(1, "long enough"), (2, "long enuogh\nother line"), (3, None)], "doc_id bigint, text string"), edits=2)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "long enough", 2: "other line", 3: None}
