import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.sources import delimited as D
from strataloom.sources.delimited import ALLOWED, COLUMNS, LENGTHS, Contract, check_rows, parse_rows, split_valid


def left_to_right(row, delimiter, quote):
    """Fields by reading one character after the other, or None if the quoting is broken."""
    fields, i = [], 0
    while True:
        if quote and row[i : i + 1] == quote:
            i, out = i + 1, []
            while True:
                if i >= len(row):
                    return None
                if row[i] != quote:
                    out.append(row[i])
                    i += 1
                elif row[i + 1 : i + 2] == quote:
                    out.append(quote)
                    i += 2
                else:
                    i += 1
                    break
            if i < len(row) and row[i] != delimiter:
                return None
            fields.append("".join(out))
        else:
            j = row.find(delimiter, i)
            j = len(row) if j < 0 else j
            if quote and quote in row[i:j]:
                return None
            fields.append(row[i:j])
            i = j
        if i >= len(row):
            return fields
        i += 1


def judge(row, delimiter, quote):
    fields = left_to_right(row, delimiter, quote)
    if fields is None:
        return "quoting", None
    if len(fields) != 7:
        return "column_count", None
    r = dict(zip(COLUMNS, fields))
    for c, (a, b) in LENGTHS.items():
        if len(r[c]) < a or (b and len(r[c]) > b):
            return "invalid_value", None
    if any(r[c] not in v for c, v in ALLOWED.items()):
        return "invalid_value", None
    return None, fields


field = st.one_of(st.text("ab,\"' \né", max_size=5), st.sampled_from(['"x"', '"a,b"', '"a""b"', "'q'", "public", "en", '""', '"', "x" * 257]))
line = st.one_of(st.lists(field, max_size=8).map(",".join), st.tuples(*[field] * 5).map(lambda f: ",".join([*f, "public", "en"])), st.text("a,\"'", max_size=20))


@settings(max_examples=400, deadline=None)
@given(st.lists(line, max_size=8), st.sampled_from(['"', "'", None]))
def test_same_as_reading_left_to_right(rows, quote):
    reasons, values = check_rows(rows, ",", quote, Contract())
    for i, row in enumerate(rows):
        want, fields = judge(row, ",", quote)
        assert reasons[i] == want
        assert [v[i] for v in values] == (fields or [None] * 7)


def test_table_with_nulls_and_clashing_names(spark):
    good = "d1|T|'a|b''c\n'|u|w|public|en"
    rows = [(1, "f", good, "x"), (2, "f", None, "x"), (3, None, 'd,"t",x,u,w,public,en', "x"), (4, "f", "", "x"), (5, "f", good + "|", "x"),
            (6, "f", "d1|T|x'y|u|w|public|en", "x"), (7, "f", "d1|T|x|u|w|Public|en", "x"), (8, "f", good, "x"), (9, "g", "d1;'T;x;u;w;public;en", "x")]
    df = spark.createDataFrame(rows, "record_id long, feed string, raw_line string, reason string")
    feeds = spark.createDataFrame([("f", "|", "'"), ("g", ";", None)], "feed string, delimiter string, quote_char string")
    valid, bad = split_valid(parse_rows(df, feeds))
    assert {r.record_id: r.reason for r in bad.collect()} == {2: "column_count", 4: "column_count", 5: "column_count", 6: "quoting", 7: "invalid_value"}
    got = {r.record_id: tuple(r)[1:] for r in valid.collect()}
    assert got[1] == got[8] == ("d1", "T", "a|b'c\n", "u", "w", "public", "en") and got[3][1] == "t" and got[9][1] == "'T"
    assert parse_rows(df.limit(0), feeds).count() == 0
    with pytest.raises(ValueError):
        parse_rows(df, spark.createDataFrame([("f", "||", "'")], "feed string, delimiter string, quote_char string"))


def test_every_row_of_a_table(spark):
    import pandas as pd

    folder = "/root/testdata/sf0.01"
    feeds = {f: (d, q) for f, d, q in pd.read_parquet(f"{folder}/raw_feeds.parquet")[["feed", "delimiter", "quote_char"]].itertuples(index=False)}
    raw = pd.read_parquet(f"{folder}/raw_records.parquet")
    from strataloom.plans.parse_queries import p4_found, p4_valid

    want = {}
    for k, f, t in raw[["record_id", "feed", "raw_line"]].itertuples(index=False):
        want[k] = judge(t, *feeds.get(f, (",", '"')))[0] if t is not None else "column_count"
    assert {r.record_id: r.reason for r in p4_found(spark, folder).collect()} == {k: v for k, v in want.items() if v}
    assert p4_valid(spark, folder).count() == sum(v is None for v in want.values())


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_record_ends_across_byte_ranges(spark, tmp_path, range_bytes):
    rows = ['a,"b\nc",d', '"x""\n""y",2', "plain,é漢", "", '"only\nquoted\r\nlines"', "last"]
    (tmp_path / "one.csv").write_bytes("\n".join(rows).encode())
    (tmp_path / "two.csv").write_bytes(("\r\n".join(["p,q", '"r\r\ns"']) + "\r\n").encode())
    got = D.read_records_of_files(spark, f"{tmp_path}/*.csv", range_bytes=range_bytes).orderBy("path", "offset").collect()
    assert [r.raw_line for r in got if r.path.endswith("one.csv")] == rows
    assert [r.raw_line for r in got if r.path.endswith("two.csv")] == ["p,q", '"r\r\ns"']
    assert [r.raw_line for r in D.read_records_of_files(spark, f"{tmp_path}/two.csv", quote=None, range_bytes=range_bytes).orderBy("offset").collect()] == ["p,q", '"r', 's"']


def test_feed_that_quotes_nothing(spark):
    rows = spark.createDataFrame([(1, "f", 'd,"t,x,u,a,public,en'), (2, "f", 'd,t"x,"y",u,a,public,en')], "record_id long, feed string, raw_line string")
    feeds = spark.createDataFrame([("f", ",", None)], "feed string, delimiter string, quote_char string")
    assert {r.record_id: (r.reason, r.title) for r in D.parse_rows(rows, feeds).collect()} == {1: (None, '"t'), 2: (None, 't"x')}
