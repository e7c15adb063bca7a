from waymark.llm import perspectives as P


def brute(rows):
    """Render each dialogue per speaker as one string, then cut it again."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is None, r[1] or 0, r[2] or "unknown", r[3] or "", r[1]) for r in rows if r[0] == conv), key=lambda t: t[:4])
        for speaker in {t[2] for t in turns} - {"system"}:
            whole = ""
            for _, _, role, text, turn in turns:
                who = "system" if role == "system" else "assistant" if role == speaker else "user"
                head = f"<|im_start|>{who}{' name=' + role if who == 'user' else ''}\n"
                begin = len(whole)
                whole += f"{head}{text}<|im_end|>\n"
                mask = (begin + len(head), len(whole) - 1) if who == "assistant" else (None, None)
                out.append((conv, speaker, turn, who, whole[begin:], begin, len(whole), *mask))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert result(P.rotate(turns)) == want
    assert result(P.rotate(turns, chunk=2)) == want


def test_odd_rows(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "hö"), (1, 2, "ann", None), (1, None, "cleo", "late"), (1, 3, None, "who"), (1, 3, None, "who"),
        (2, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 5, "bob", ""), (3, 1, "ann", "y" * 100_000),
    ]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, speaker string")
    assert result(P.rotate(turns)) == brute(rows)
    assert P.rotate(turns.limit(0)).count() == 0
