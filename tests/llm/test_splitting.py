import random

import pytest

from strataloom.llm import splitting as S

STRATEGIES = [("w", "1", 7, 2), ("w", "2", 4, 0), ("x", "1", 5, 4), ("y", "1", 1, 0), ("big", "1", 500, 3), ("none", "1", None, 1), ("odd", "1", 6, None), ("over", "1", 3, 9)]
WHITE = {chr(c) for c in S.WHITE}


def brute(text, size, overlap):
    """The pieces by definition, token after token."""
    tokens, i = [], 0
    while i < len(text):
        if text[i] in WHITE:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] not in WHITE:
            j += 1
        tokens.append((i, j))
        i = j
    n = len(tokens)
    if not n:
        return []

    def strength(t):
        gap = text[tokens[t - 1][1] : tokens[t][0]].replace("\r\n", "\n")
        breaks = sum(ord(c) in S.BREAKS for c in gap)
        if breaks:
            return 3 if breaks > 1 else 2
        # up to two closing marks may follow the end of a sentence
        tail = text[: tokens[t - 1][1]]
        for _ in range(3):
            if tail and tail[-1] in S.ENDERS:
                return 1
            if not tail or tail[-1] not in S.CLOSERS:
                return 0
            tail = tail[:-1]
        return 0

    cuts = [n]
    if n > size:
        slack = (size - overlap) // 2
        step = size - overlap - slack
        cuts, k = [], 1
        while overlap + k * step < n:
            top = overlap + k * step
            cuts.append(max(range(top - max(slack, 1) + 1, top + 1), key=lambda t: (strength(t), t)))
            k += 1
        cuts.append(n)
    out, before = [], None
    for c in cuts:
        first = 0 if before is None else before - overlap
        out.append((first, c - first, tokens[first][0], tokens[c - 1][1]))
        before = c
    return out


def texts(n=40):
    rng = random.Random(5)
    bits = ["word", "a", "End.", 'said."', "é漢。", "x!)", "\"", ".", "1.5"]
    gaps = [" ", "  ", "\n", "\n\n", "\r\n", " \r\n \r\n", "　", " ", "\t"]
    made = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(0, 70))) for _ in range(n)]
    return made + ["", " ", "one", "\n\n lead", "a" * 300 + " b", "a\r\nb", "x" + " " * 90 + "y. z " * 9, "\r\n" * 40 + "q"]


@pytest.fixture(scope="module")
def strategies(spark):
    return spark.createDataFrame(STRATEGIES, "strategy_name string, strategy_version string, chunk_size_tokens int, chunk_overlap_tokens int")


def want_of(made):
    want = set()
    for d, t in enumerate(made):
        for name, version, size, overlap in STRATEGIES:
            if size is not None:
                for p in enumerate(brute(t, size, min(max(overlap or 0, 0), size - 1))):
                    want.add((d, name, version, p[0], *p[1]))
    return want


@pytest.mark.parametrize("range_chars", [S.RANGE_CHARS, 64, 11, 3])
def test_pieces_equal_the_definition(spark, strategies, range_chars):
    made = texts()
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(made)] + [(900, None, 9, "x"), (0, made[0], 9, "x")], "d int, t string, n_tokens int, strategy_name string")
    rows = S.split_texts(df, strategies, ["d"], "t", range_chars=range_chars).collect()
    got = {(r.d, r.strategy_name, r.strategy_version, r.piece_no, r.first_token, r.n_tokens, r.char_start, r.char_end) for r in rows}
    assert got == want_of(made) and len(rows) == len(got)
    sizes = {(a, b): c for a, b, c, _ in STRATEGIES}
    assert all(r.n_tokens <= sizes[r.strategy_name, r.strategy_version] for r in rows)


def test_only_cut_and_empty(spark, strategies):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c")], "d int, t string")
    rows = S.split_texts(df, strategies.filter("strategy_name = 'w' and strategy_version = '1'"), ["d"], "t", only_cut=True).collect()
    assert {r.d for r in rows} == {1} and {r.n_pieces for r in rows} == {2}
    assert S.split_texts(df.limit(0), strategies, ["d"], "t").count() == 0
    assert S.split_texts(df, strategies.limit(0), ["d"], "t").count() == 0


@pytest.mark.parametrize("range_bytes", [37, 1 << 20])
def test_files_by_byte_range(spark, strategies, tmp_path, range_bytes):
    made = [t for t in texts(12) if t]
    for i, t in enumerate(made):
        (tmp_path / f"{i:03d}.txt").write_bytes(t.encode())
    rows = S.split_files(spark, str(tmp_path), strategies, range_bytes).collect()
    got = {(int(r.path[-7:-4]), r.strategy_name, r.strategy_version, r.piece_no, r.first_token, r.n_tokens, r.char_start, r.char_end) for r in rows}
    want = {(d, a, b, k, f, n, len(made[d][:s].encode()), len(made[d][:e].encode())) for d, a, b, k, f, n, s, e in want_of(made)}
    assert got == want


def test_long_text_over_many_ranges(spark, strategies):
    text = " ".join(f"w{i}{'.' if i % 9 == 0 else ''}" + ("\n\n" if i % 131 == 0 else "") for i in range(30_000))
    assert len(text) > 10 * S.RANGE_CHARS
    rows = S.split_texts(spark.createDataFrame([(0, text), (0, text)], "d int, t string"), strategies, ["d"], "t", only_cut=True).collect()
    got = {(r.d, r.strategy_name, r.strategy_version, r.piece_no, r.first_token, r.n_tokens, r.char_start, r.char_end) for r in rows}
    assert got == want_of([text]) and len(rows) == len(got) == len({(r.strategy_name, r.strategy_version, r.piece_no) for r in rows})


@pytest.mark.parametrize("range_bytes", [37, 64, 1 << 20])
def test_file_that_is_not_utf8_is_read_one_way(spark, strategies, tmp_path, range_bytes):
    """One stray byte makes all of the file Latin-1, so that no range takes a byte of a character for white space."""
    raw = "à la carte. été ".encode() * 9 + b"\xff end" + "voilà là\n".encode() * 9
    (tmp_path / "000.txt").write_bytes(raw)
    (tmp_path / "001.txt").write_bytes("à la carte. été ".encode() * 20)
    rows = S.split_files(spark, str(tmp_path), strategies, range_bytes).collect()
    got = {(int(r.path[-7:-4]), r.strategy_name, r.strategy_version, r.piece_no, r.first_token, r.n_tokens, r.char_start, r.char_end) for r in rows}
    plain = "à la carte. été " * 20
    want = want_of([raw.decode("latin-1")]) | {(1, a, b, k, f, n, len(plain[:s].encode()), len(plain[:e].encode())) for _, a, b, k, f, n, s, e in want_of([plain])}
    assert got == want
