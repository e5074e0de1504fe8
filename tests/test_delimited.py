"""Delimited text in small splits, against Python's csv module."""

import csv
import io
import math

import numpy as np
import pytest

from tidemill.errors import InputError
from tidemill.sources import delimited, readers, writers


@pytest.fixture
def split_bytes(spark):
    """Sets the size of splits for a test."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def setter(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield setter
    for k, v in held.items():
        spark.conf.set(k, v)


def texts(rng, n):
    words = ["plain", "a,b", 'say "hi"', "two\nlines", "x\r\ny", "\n\n", '"', "5\" pipe", "end,\n", "é漢", "tab\t", "", '"",""\n"']
    return [(i, str(rng.choice(words)) + str(rng.choice(words)), int(rng.integers(-9, 9)) / 4) for i in range(n)]


def written(rows, encoding="utf-8", sep=",", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, quoting=quoting, lineterminator="\n")
    w.writerow(["id", "te xt ", "x"])
    w.writerows(rows)
    return out.getvalue().encode(encoding)


@pytest.mark.parametrize("encoding, sep, quoting", [("utf-8", ",", csv.QUOTE_MINIMAL), ("utf-8-sig", ";", csv.QUOTE_ALL), ("gb18030", "|", csv.QUOTE_MINIMAL)])
@pytest.mark.parametrize("size", [150, 1 << 20])
def test_values_over_several_splits(spark, tmp_path, split_bytes, encoding, sep, quoting, size):
    rows = texts(np.random.default_rng(size), 60)
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_bytes(written(rows[k * 30 : k * 30 + 30], encoding, sep, quoting))
    split_bytes(size)
    want = sorted((i, t or None, x) for i, t, x in rows)
    got = readers.read_csv(spark, str(tmp_path / "in"))
    assert got.dtypes == [("id", "bigint"), ("te xt", "string"), ("x", "double")]
    assert sorted(map(tuple, got.collect())) == want
    made = readers.ingest_csv(spark, str(tmp_path / "in"), str(tmp_path / "table"))
    assert made.dtypes == got.dtypes and sorted(map(tuple, made.collect())) == want


def test_an_export_reads_back(spark, tmp_path):
    rows = [(1, " edge ", 0.5), (2, "two\nlines\n", None), (3, 'say "hi", or', 2.0), (4, None, 1.0), (5, "\t", 1.0)]
    writers.write_csv(spark.createDataFrame(rows, "id long, t string, x double").repartition(3), str(tmp_path / "o.csv"))
    writers.write_csv(spark.createDataFrame(rows, "id long, t string, x double").repartition(3), str(tmp_path / "o.csv"))
    assert sorted(map(str, map(tuple, readers.read_csv(spark, str(tmp_path / "o.csv")).collect()))) == sorted(map(str, rows))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["o.csv"]


def test_torn_pairs_stay_together(spark, tmp_path):
    path = tmp_path / "torn.csv"
    path.write_text('id,note\n1,"x\n2,y"\n3,z\n')
    for df in (readers.read_csv(spark, str(path)), readers.ingest_csv(spark, str(path), str(tmp_path / "t"))):
        assert sorted(map(tuple, df.collect())) == [(1, "x\n2,y"), (3, "z")]


def test_a_value_as_long_as_many_splits(spark, tmp_path, split_bytes):
    long = "\n".join(f"line {i}, and more" for i in range(150))
    (tmp_path / "long.csv").write_bytes(written([(1, "a", 1), (2, long, 2), (3, '"', 3)]))
    split_bytes(200)
    got = readers.read_csv(spark, str(tmp_path / "long.csv"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, long, 2), (3, '"', 3)]
    assert sorted(map(tuple, readers.ingest_csv(spark, str(tmp_path / "long.csv"), str(tmp_path / "t")).collect())) == sorted(map(tuple, got.collect()))


def test_a_header_over_several_lines_and_splits(spark, tmp_path, split_bytes):
    (tmp_path / "h.csv").write_text('"a\nb","c\nd",e,e,\n' + "".join(f"{i},2,3,4,5\n" for i in range(9)))
    split_bytes(9)
    got = readers.read_csv(spark, str(tmp_path / "h.csv"))
    assert got.columns == ["a\nb", "c\nd", "e", "e.1", "Unnamed: 4"] and sorted(r[0] for r in got.collect()) == list(range(9))


def test_numbers_with_suffixes_are_text(spark, tmp_path):
    path = tmp_path / "suffix.csv"
    path.write_text("v,w,d\n" + "".join(f"{i},{i}.5,2024-01-05\n" for i in range(120000)) + "12d,7F,2024-01-05 10:00:00\n")
    for df in (readers.read_csv(spark, str(path)), readers.ingest_csv(spark, str(path), str(tmp_path / "t"))):
        assert df.dtypes == [("v", "string"), ("w", "string"), ("d", "timestamp_ntz")]
        assert [tuple(r)[:2] for r in df.where("v = '12d'").collect()] == [("12d", "7F")] and df.count() == 120001


def test_kinds_of_columns(spark, tmp_path):
    (tmp_path / "k.csv").write_text("i,f,b,d,t,n,m,z\n1,1,true,2024-02-29,2024-01-01 00:00:01,,007,1e400\n-2,NA,FALSE,,NULL,nan,x,-inf\n")
    got = readers.read_csv(spark, str(tmp_path / "k.csv"))
    assert [k for _, k in got.dtypes] == ["bigint", "bigint", "boolean", "date", "timestamp_ntz", "string", "string", "double"]
    second = got.where("i = -2").first()
    assert second["f"] is None and second["b"] is False and second["n"] is None and second["z"] == -math.inf


def test_short_long_and_blank_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b,c\n1,"x"\n\n2\n3,"y\nz",4\n')
    assert sorted(map(str, map(tuple, readers.read_csv(spark, str(tmp_path / "s.csv")).collect()))) == ["(1, 'x', None)", "(2, None, None)", "(3, 'y\\nz', 4)"]
    (tmp_path / "l.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="3 values for 2 columns"):
        readers.read_csv(spark, str(tmp_path / "l.csv")).collect()
    (tmp_path / "only.csv").write_text("a,b\n")
    assert readers.ingest_csv(spark, str(tmp_path / "only.csv"), str(tmp_path / "t")).dtypes == [("a", "string"), ("b", "string")]
    (tmp_path / "none.csv").write_text(" \n")
    with pytest.raises(InputError, match="empty"):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


def test_a_comma_where_the_separator_gives_no_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a;b;c,d\n1;2;3,4\nx;y;z;more,5\n")
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c.csv")).collect())) == [("1;2;3", 4), ("x;y;z;more", 5)]
    assert readers.read_csv(spark, str(tmp_path / "c.csv")).columns == ["a;b;c", "d"]


def test_a_told_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y,z\n1,12d,2.50\n2,3.5,bad\n")
    got = readers.read_csv(spark, str(tmp_path / "t.csv"), "k int, v double, w decimal(5,2)")
    assert got.dtypes == [("k", "int"), ("v", "double"), ("w", "decimal(5,2)")]
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, None, Decimal('2.50'))", "(2, 3.5, None)"]


def test_changed_splits_are_told(spark, tmp_path, split_bytes):
    (tmp_path / "s.csv").write_bytes(written([(i, "a\n" * 30, 1) for i in range(30)]))
    split_bytes(100)
    df = readers.read_csv(spark, str(tmp_path / "s.csv"))
    split_bytes(333)
    with pytest.raises(Exception, match="read them again"):
        df.collect()


@pytest.mark.parametrize("sep", [",", ";"])
def test_quotes_against_a_walk(sep):
    """The states by parity or by walking are those of reading byte by byte."""
    rng = np.random.default_rng(7)
    for _ in range(3000):
        text = "".join(rng.choice(['"', '"', sep, "\n", "a"], int(rng.integers(0, 30)))).encode()
        for inside in (False, True):
            state, begins, want, k = inside, True, [], 0
            while k < len(text):
                c = text[k : k + 1]
                if c == b'"':
                    if state and text[k + 1 : k + 2] == b'"':
                        want += [True, True]
                        k += 2
                        begins = False
                        continue
                    state = (not state) if state else begins
                    want.append(state)
                begins = not state and c in (sep.encode(), b"\n")
                k += 1
            at, got = delimited.quote_states(np.frombuffer(text, np.uint8), inside, ord(sep))
            # where a value begins with a quote pair, what stands between the two is nothing
            states = {i: g for i, g in zip(at.tolist(), got.tolist())}
            breaks = [i for i, c in enumerate(text) if c == 10]

            def at_break(i, s):
                before = [x for x in at.tolist() if x < i]
                return s[before.index(before[-1])] if before else inside

            assert [at_break(i, got.tolist()) for i in breaks] == [at_break(i, want) for i in breaks], (text, inside, states)


@pytest.mark.parametrize("first", ["0,plain\n", '0,"a\nb"\n'])
def test_values_torn_between_splits_are_parsed_once(spark, tmp_path, monkeypatch, first):
    (tmp_path / "in.csv").write_text("n,t\n" + first * 400 + "".join(f'{i},"v\n{i},""\n"\n' for i in range(4000)))
    monkeypatch.setattr(delimited, "read", None)  # looks at the whole text again
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4001b")
    try:
        got = readers.ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(0, first[2:].strip('"\n'))] * 400 + [(i, f'v\n{i},"\n') for i in range(4000)]
    assert got.columns == ["n", "t"] and sorted(map(tuple, got.collect())) == sorted(want)


def typed_rows(df):
    return df.dtypes, sorted(map(str, map(tuple, df.collect())))


def test_a_first_file_without_rows_tells_no_types(spark, tmp_path):
    """Spark itself writes such a file where the first partition has no rows."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.csv").write_text("n,t,x,d\n")
    (tmp_path / "in" / "1.csv").write_bytes("n,t,x,d\n".encode() + "".join(f'{i},"é漢\n{i}",{i}.5,2024-01-05\n' for i in range(50)).encode("gb18030"))
    got = readers.ingest_csv(spark, str(tmp_path / "in"), str(tmp_path / "t"))
    assert got.dtypes == [("n", "bigint"), ("t", "string"), ("x", "double"), ("d", "date")]
    assert sorted(r[:3] for r in map(tuple, got.collect())) == [(i, f"é漢\n{i}", i + 0.5) for i in range(50)]


@pytest.mark.parametrize("later", ["7,1.5,2024-01-05,007x,,-3", "7,2,2024-01-05 10:00:00,true,5,", "x,z,z,z,z,z"])
@pytest.mark.parametrize("size", [4001, 1 << 26])
def test_columns_that_are_empty_in_the_head(spark, tmp_path, split_bytes, monkeypatch, later, size):
    monkeypatch.setattr(readers, "SNIFF_BYTES", 2000)
    rows = ['1,,,,,\n2,,,,,"a\nb"\n'] * 300 + [f"{later}\n"] * 9 + ["3,1,2024-01-06,NA,,4\n"] * 300 + [",,,,,\n"] * 300
    (tmp_path / "in.csv").write_text("n,x,d,t,z,m\n" + "".join(rows))
    split_bytes(size)
    want = typed_rows(readers.read_csv(spark, str(tmp_path / "in.csv")))
    assert typed_rows(readers.ingest_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "t"))) == want


def test_one_record_without_a_line_end(spark, tmp_path):
    (tmp_path / "one.csv").write_text("n,x\n1,2.5")
    got = readers.ingest_csv(spark, str(tmp_path / "one.csv"), str(tmp_path / "t"))
    assert got.dtypes == [("n", "bigint"), ("x", "double")] and got.collect() == [(1, 2.5)]
