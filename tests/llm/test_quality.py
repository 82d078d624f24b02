import math

import numpy as np
import pandas as pd
import pytest

from strataloom.llm import quality as Q
from strataloom.llm.quality_queries import p8_found
from strataloom.llm.text_parts import CommonWords, read_texts

COMMON = CommonWords([("en", w) for w in "the of and to in is that for it was with we".split()] + [("ja", "の"), ("ja", "は")])
PROSE = "We found that the index was slow. It is clear that the worker read to the end of the file."
KINDS = [
    (PROSE, None), (PROSE.replace(" ", "\n", 9), None), ("- " + PROSE + "\n\n" + PROSE, None), (PROSE.replace(" ", "\n    ", 3), None),
    ("この研究の値は低い。", None), ("Short note to the team.", None),
    ("The value of the index was slow and it is\nzanpur stayed entirely changed. See also note rk-nxklo.", None),
    ("- red apple\n- green pear\n   - blue plum", "list"), ("red apple\ngreen pear\nblue plum\nold fig", "list"), ("1) We read it to the end.\n2) It was slow.\n3) The end.", "list"),
    ("a,b,c\n1,2,3\n4,,6", "table"), ("a | b | c\n1 | 2 | 3\n4 |  | 6", "table"), ("name      cost      rows\nx1        2         3\ny1        5         6", "table"), ("a\tb\n1\t2\n3\t4", "table"),
    ("xx vbn qwr tzz kkl pwr mnb vcx lkj hgf", "junk"), ("af 21 e1 9f 01 88 b2 33 a7 aa 2b b4", "junk"), ("Home » Top » Help » Menu » Login » Search » Next", "junk"), ("test " * 30, "junk"),
    ("N/A " * 20, "junk"), (PROSE.encode().decode("latin-1") + "Ã©Ã¨Ã¤Ã¶" * 20, "junk"), ("}{:;<>?@#$ %^&*( )_+=-[ ]\\|/ ~`!", "junk"),
    (PROSE + "\na,b,c\n1,2,3", None), (PROSE + "\n" + "a,b,c,d,e\n" * 40, "table"),
]


def read_text(text, common):
    return read_texts([text], common)[0]


def kind_of(parts):
    kind = max(Q.KINDS, key=parts.__getitem__)
    return kind if parts[kind] > 0 and sum(parts[k] for k in Q.KINDS) > parts["prose"] else None


@pytest.mark.parametrize("text,kind", KINDS)
def test_kind(text, kind):
    assert kind_of(read_text(text, COMMON)[1]) == kind


def test_statistics():
    stats, _ = read_text("The cat, the dog.\n\nNo end", COMMON)
    assert stats["n_words"] == 6 and stats["punctuated_lines"] == 0.5 and math.isclose(stats["common_words"], 2 / 6)
    assert math.isclose(stats["mean_word_length"], 17 / 6) and math.isclose(stats["symbol_ratio"], 2 / 19) and math.isclose(stats["distinct_words"], 5 / 6)


def test_characters_are_counted_by_class():
    texts = ["a1 \u00e9!", "\U0001f600\U0001f600x", "\u6f22\u5b57\u3002 2", "\t\n"]
    got = read_texts(texts[:3], COMMON)
    assert [round(g[0]["symbol_ratio"], 6) for g in got] == [0.25, round(2 / 3, 6), 0.25]
    assert [g[0]["digit_ratio"] for g in got] == [0.25, 0, 0.25]


@pytest.mark.parametrize("text", ["7b ad f6 d8 88 d8 16 5f ac 53 5e 07 65 d1 8f a e d3 34 9e c8 32 42 1b ea", '{"0ob":[2026,7366],"we8":[7892,5047],"a":[3942,6907],"in7":[1242,8480],"to":[1,2],"of9":[3],"is":[4],"that":[5]}'])
def test_dumps_with_common_words_among_them(text):
    assert kind_of(read_text(text, COMMON)[1]) == "junk"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")


def words(spark):
    return spark.createDataFrame([("en", w) for w in COMMON.alone] + [("ja", "の")], "lang string, word string")


def test_ranks_and_scores_equal_brute_force(spark):
    texts = [k[0] for k in KINDS] * 3 + [None, "", "  \n", "x" * 200_000]
    rows = [(i, t, ["en", "EN-gb", "ja", None, "xx", " en_US"][i % 6], "old") for i, t in enumerate(texts)]
    got = Q.scored_texts(frame(spark, rows), words(spark)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(got) == len(rows)
    assert got.language.tolist() == [["en", "en", "ja", "und", "und", "en"][i % 6] for i in range(len(rows))]
    texts = [r[1] for r in rows]
    contents = got.assign(text=texts)[got.n_words.notna()].drop_duplicates(["language", "text"])
    score = np.zeros(len(got))
    for s in Q.STATISTICS:
        for i, v in got[s][got[s].notna()].items():
            own = contents[contents.language == got.language[i]][s]
            mixed = {side: (part(own).sum() + Q.PRIOR * part(contents[s]).mean()) / (len(own) + Q.PRIOR) for side, part in (("lower", lambda x: x <= v), ("upper", lambda x: x >= v))}
            tail = mixed[Q.SIDES[s]] if s in Q.SIDES else min(mixed.values())
            assert math.isclose(got[f"tail_{s}"][i], tail)
            score[i] -= math.log(tail) * (s in Q.SIDES)
    blank = got.n_words.isna()
    assert blank.sum() == 3 and got.outlier_score[blank].isna().all() and got.kind[blank].isna().all()
    assert np.allclose(score[~blank], got.outlier_score[~blank])


def test_empty_tables(spark):
    assert Q.scored_texts(frame(spark, []), words(spark)).count() == 0
    assert Q.scored_texts(frame(spark, [(1, None, None, None)]), words(spark).limit(0)).collect()[0].outlier_score is None


def test_ranks_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({s: rng.integers(0, 40, 500) / 40 for s in Q.STATISTICS}).assign(doc_id=range(500), language=rng.choice(["en", "ja"], 500), digest=[bytes([i % 250, i // 250]) for i in range(500)])
    twice = pd.concat([pdf, pdf[:100]])
    ranks = Q.exact_ranks(spark.createDataFrame(twice)).toPandas()
    for r in ranks.itertuples():
        every = pdf[Q.STATISTICS[r.statistic]]
        g = every[pdf.language == r.language]
        assert (r.below, r.upto, r.total) == ((g < r.value).sum(), (g <= r.value).sum(), len(g))
        assert (r.all_below, r.all_upto, r.all_total) == ((every < r.value).sum(), (every <= r.value).sum(), 500)
        assert r.copies == ((twice.language == r.language) & (twice[Q.STATISTICS[r.statistic]] == r.value)).sum()


def test_found_in_tiny_languages_and_among_copies(spark, tmp_path):
    """Ranks need a corpus; given one, neither a language of one document nor a text that a third of all rows repeat escapes."""
    junk = "xx vbn qwr tzz kkl pwr mnb vcx lkj hgf"
    rows = [(i, f"{PROSE} It was the {'of ' * (i % 7)}end, and that is {i} to the team.", "en") for i in range(60)] + [(100, junk, None)] + [(200 + i, junk, "ja") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    words(spark).write.parquet(f"{tmp_path}/common_words.parquet")
    got = sorted(map(tuple, p8_found(spark, str(tmp_path)).collect()))
    assert got == [(i, "junk") for i in (100, *range(200, 230))]


def test_the_score_decides(spark):
    """A text that reads as a list is none by its score where nearly all contents are alike."""
    rows = [(i, f"- red apple {i}\n- green pear\n- blue plum", "en") for i in range(80)] + [(900 + i, f"{PROSE} {i}", "en") for i in range(4)]
    scored = Q.scored_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), words(spark))
    assert scored.filter("list_share > 0.9").count() == 80 and Q.not_prose(scored).count() == 0


def test_statistics_are_not_rounded(spark):
    long = ["the " * n + "end." for n in (12_346, 12_347)]
    texts = long + ["a" * n + "," for n in (3000, 4000)] + ["test " * 30] * 60
    got = Q.scored_texts(frame(spark, [(i, t, "en", "old") for i, t in enumerate(texts)]), words(spark)).toPandas().sort_values("doc_id")
    assert got.n_words.tolist()[:2] == [12_347, 12_348] and np.allclose(got.tail_n_words.tolist()[:2], [2 / 5, 1 / 5])
    assert got.symbol_ratio.tolist()[2:4] == [1 / 3001, 1 / 4001] and len(set(got.symbol_ratio)) == 5


def test_repeated_token_after_a_varied_opening():
    assert kind_of(read_text("Loud green birds often sing near quiet rivers. " + "the " * 40, COMMON)[1]) == "junk"
    assert kind_of(read_text("a | b | c | d\n1 | 2 | 3 | 4\n5 | 6 | 7 | 8", COMMON)[1]) == "table"
