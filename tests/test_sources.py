import json
import random
from types import SimpleNamespace

import duckdb
import pytest

from twinledger.sources import hygiene
from twinledger.sources.file_dialects import read_text_folder
from twinledger.sources.delimited import encoding_of, header_search, numbered_lines, read_csv, read_text, read_tsv
from twinledger.sources.quoted_records import ends_inside, stays_inside
from twinledger.sources.fixed_width import APPLICANT_LAYOUT, layout_from_text, read_fixed_width
from twinledger.sources.json_arrays import json_pieces, json_records
from twinledger.sources.structured import database_reader, read_json, read_parquet, read_sql, split_with_clause


def put(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_keeps_zeros_and_null_tokens(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id, name ,empty\n00123,"Doe, J",\n00124,NULL,NA\n00125,"say ""x""",\n')
    df = read_csv(spark, path)
    assert df.columns == ["id", "name"]
    assert rows(df) == [("00123", "Doe, J"), ("00124", None), ("00125", 'say "x"')]
    assert read_csv(spark, path, keep_empty=True).columns == ["id", "name", "empty"]


def test_csv_latin1(spark, tmp_path):
    path = put(tmp_path, "latin1.csv", "k,v\n1,é\n", "latin-1")
    assert encoding_of(spark, path) == "ISO-8859-1"
    assert rows(read_csv(spark, path)) == [("1", "é")]
    # the replacement character itself is valid UTF-8
    path = put(tmp_path, "utf8.csv", "k,v\n1,�é\n")
    assert encoding_of(spark, path) == "UTF-8"
    assert rows(read_csv(spark, path)) == [("1", "�é")]


def test_tsv_and_byte_order_mark(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "﻿k\tv\n1\ta,b\n")
    df = read_tsv(spark, path)
    assert df.columns == ["k", "v"] and rows(df) == [("1", "a,b")]


def test_csv_multi_line(spark, tmp_path):
    path = put(tmp_path, "m.csv", 'k,v\n1,"a\nb"\n')
    assert rows(read_csv(spark, path, multi_line=True)) == [("1", "a\nb")]


class small_blocks:
    """Files are read in blocks of a few hundred bytes."""

    def __init__(self, spark, size):
        self.conf, self.size = spark.conf, size

    def __enter__(self):
        self.old = {k: self.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        for k in self.old:
            self.conf.set(k, str(self.size))

    def __exit__(self, *_):
        for k, v in self.old.items():
            self.conf.set(k, v)


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_multi_line_csv_in_many_blocks_equals_duckdb(spark, tmp_path, size):
    """Values with line breaks, doubled quotes, delimiters and blank lines, some longer than several blocks, in two files."""
    rng = random.Random(5)
    bits = ["a", "bc", '""', ",", "\n", "\n\n", "é", " ", "x" * 30, "\n,\n", '"",""']
    n = 0
    for k in range(2):
        text = "k,v,w\n"
        for _ in range(80):
            n += 1
            values = ['"' + "".join(rng.choices(bits, k=rng.choice((0, 1, 5, 40)))) + '"' if rng.random() < 0.6 else rng.choice(["", "plain", '5"in', "x y"])
                      for _ in range(2)]
            text += f"id{n},{values[0]},{values[1]}\n"
        put(tmp_path, f"part{k}.csv", text)
    with small_blocks(spark, size):
        df = read_csv(spark, str(tmp_path), multi_line=True, null_tokens=[], encoding="UTF-8")
        got = {r.k: (r.v or "", r.w or "") for r in df.collect()}
        assert df.count() == n
    want = duckdb.sql(f"SELECT k, coalesce(v, ''), coalesce(w, '') FROM read_csv('{tmp_path}/*.csv', all_varchar=true, header=true, quote='\"', escape='\"', delim=',', strict_mode=false)").fetchall()
    assert got == {k: (v, w) for k, v, w in want} and len(got) == n


def test_line_functions_are_those_of_a_plain_reader(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choices('ab",,"', k=rng.randint(0, 9))) for _ in range(1500)]

    def plain(line, inside):
        at_start, i = not inside, 0
        while i < len(line):
            if inside:
                if line[i] == '"' and line[i + 1:i + 2] == '"':
                    i += 1
                elif line[i] == '"':
                    inside = False
                at_start = False
            elif line[i] == '"' and at_start:
                inside, at_start = True, False
            else:
                at_start = line[i] == ","
            i += 1
        return inside

    df = spark.createDataFrame([(x,) for x in lines], "x string").selectExpr("x", f"{ends_inside('x', ',')} AS o", f"{stays_inside('x', ',')} AS i")
    assert all((r.o, r.i) == (plain(r.x, False), plain(r.x, True)) for r in df.collect())
    # A long line needs no deep recursion.
    long = spark.createDataFrame([('"' + 'ab""' * 300_000 + '",x,"' + 'y""' * 300_000,), ("a," * 300_000 + '"b',)], "x string")
    assert [r[0] for r in long.selectExpr(ends_inside("x", ",")).collect()] == [True, True]


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    for folder, k, lines in (("c", 0, "id,name\n1,ann\n"), ("c", 1, "name,id\nbob,2\n"), ("t", 0, "title\nid|name\n1|ann\n"), ("t", 1, "title\nname|id\nbob|2\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        put(tmp_path / folder, f"part{k}.txt", lines)
    for multi_line in (False, True):
        with pytest.raises(ValueError, match="another header"):
            read_csv(spark, str(tmp_path / "c"), multi_line=multi_line)
    with pytest.raises(ValueError, match="another header"):
        read_text(spark, str(tmp_path / "t"), header_row=1)


def test_open_quotes_and_inch_marks(spark, tmp_path):
    with pytest.raises(ValueError, match="leave a quote open"):
        read_text(spark, put(tmp_path, "broken.txt", 'id|name\n1|"a\nb"\n'))
    with pytest.raises(ValueError, match="end within quotes"):
        read_csv(spark, put(tmp_path, "endless.csv", 'id,name\n1,"a\nb\n'), multi_line=True)
    path = put(tmp_path, "inch.tsv", 'id\tpart\n1\t5" pipe\n2\t7" x 5"\n3\t"quoted ""pipe"""\n')
    assert rows(read_tsv(spark, path)) == [("1", '5" pipe'), ("2", '7" x 5"'), ("3", 'quoted "pipe"')]


def test_duplicate_header(spark, tmp_path):
    with pytest.raises(ValueError, match="duplicate"):
        read_csv(spark, put(tmp_path, "dup.csv", "a,a ,b\n1,2,3\n"))


def test_text_with_titles_and_footer(spark, tmp_path):
    content = "Report\n\nprinted | today\nid|name|units\n01|x|1,234.5\n02|y|7\n03|z|NA\nTotal||1241\nend\n"
    path = put(tmp_path, "titled.txt", content)
    df = read_text(spark, path, header_row=2, skip_footer=2)
    assert dict(df.dtypes) == {"id": "string", "name": "string", "units": "double"}
    assert rows(df) == [("01", "x", 1234.5), ("02", "y", 7.0), ("03", "z", None)]
    searched = read_text(spark, path, header_row="search", skip_footer=2)
    assert rows(searched) == rows(df)
    assert dict(read_text(spark, path, 2, 2, type_hint="text").dtypes)["units"] == "string"
    assert rows(read_text(spark, path, 2, 2, type_hint="numeric")) == [(1.0, 1234.5), (2.0, 7.0), (3.0, None)]


def test_text_folder_drops_titles_and_footers_of_every_file(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"part{k}.txt", f"title {k}\nk\tv\n" + "".join(f"{k}{i}\t{i}\n" for i in range(1, 4)) + "total\t6\n")
    df = read_text(spark, str(tmp_path), header_row=1, skip_footer=1)
    assert df.count() == 9


def test_line_numbers_across_blocks(spark, tmp_path):
    """A file read in many blocks is numbered as a whole."""
    path = put(tmp_path, "long.txt", "".join(f"line {i}\n" + ("\n" if i % 7 == 0 else "") for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = numbered_lines(spark, path)
        assert lines.rdd.getNumPartitions() >= 1
        got = sorted((r.line_no, r.value) for r in lines.collect())
        assert lines.select("lines_in_file").distinct().collect()[0][0] == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f"line {i}") for i in range(5000)]


def test_european_numbers(spark, tmp_path):
    path = put(tmp_path, "eu.txt", "k\tprice\nA1\t1.234,5\nA2\t7\n")
    assert rows(read_text(spark, path, locale="EU")) == [("A1", 1234.5), ("A2", 7.0)]


def test_latin1_text_keeps_the_locale(spark, tmp_path):
    path = put(tmp_path, "eu1.txt", "k|größe\nä|1.234,5\nb|2\n", "latin-1")
    df = read_text(spark, path, locale="EU")
    assert df.columns == ["k", "größe"] and rows(df) == [("b", 2.0), ("ä", 1234.5)]


def test_header_search(spark):
    lines = spark.createDataFrame([(0, "title"), (1, "a,b,"), (2, "x,y,z"), (3, "1,2,3"), (11, "1,2,3,4")], "line_no bigint, value string")
    assert tuple(header_search(lines).first()) == (2, 3)


def test_text_arguments(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a,b\n1,2\n")
    for bad in ({"header_row": 21}, {"skip_footer": -1}, {"type_hint": "x"}, {"header_row": 5}):
        with pytest.raises(ValueError):
            read_text(spark, path, **bad)


def test_fixed_width(spark, tmp_path):
    layout = layout_from_text("a, b, c", "0:2, 2:6, 6:10")
    path = put(tmp_path, "layout.txt", "01 x  12  \n02    NA  \n03éé    \n")
    assert rows(read_fixed_width(spark, path, layout)) == [("01", "x", "12"), ("02", None, None), ("03", "éé", None)]
    with pytest.raises(ValueError):
        layout_from_text("a", "0:2, 2:4")


def test_applicant_layout(spark, tmp_path):
    layout = APPLICANT_LAYOUT
    assert len(layout) == 58 and layout[-1][2] == 203 and all(x[2] == y[1] for x, y in zip(layout, layout[1:]))
    assert len(layout) == 58 and layout[-1][2] == 203
    assert layout[2] == ("Identification Number", 3, 13) and layout[43] == ("Applicant Name", 78, 113)
    assert all(x[2] == y[1] for x, y in zip(layout, layout[1:]))
    line = "".join(str(i % 10) * (e - s) for i, (_, s, e) in enumerate(layout))
    df = read_fixed_width(spark, put(tmp_path, "gad.txt", line + "\n"), layout)
    assert [df.first()[i] for i in (0, 1, 43)] == ["0", "11", "3" * 35]


def test_json_and_parquet(spark, tmp_path):
    path = put(tmp_path, "records.json", '[{"k":1,"v":null, "e":null},{"k":2,"v":"x", "e":null}]')
    assert rows(read_json(spark, path)) == [(1, None), (2, "x")]
    path = put(tmp_path, "lines.json", '{"k":1}\n{"k":2}\n')
    assert rows(read_json(spark, path, lines=True)) == [(1,), (2,)]
    target = str(tmp_path / "t.parquet")
    spark.sql("SELECT 1 AS ` k `, CAST(NULL AS STRING) AS e").write.parquet(target)
    assert read_parquet(spark, target).columns == ["k", "e"]
    assert read_parquet(spark, target, keep_empty=False).columns == ["k"]


def test_sql_over_views(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "id int, term int")
    query = """WITH latest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY term DESC) AS r FROM {t})
               SELECT id, term FROM latest WHERE r = 1"""
    assert rows(read_sql(spark, query, t=df)) == [(1, 2), (2, 5)]


def test_database_options(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr("pyspark.sql.DataFrameReader.options", lambda self, **o: seen.update(o) or self)
    database_reader(spark, "jdbc:x", query="SELECT * FROM t", with_clause="WITH t AS (SELECT 1 AS a)", user="u")
    assert seen == {"url": "jdbc:x", "query": "SELECT * FROM t", "prepareQuery": "WITH t AS (SELECT 1 AS a)",
                    "loginTimeout": "10", "fetchsize": "10000", "user": "u"}
    seen.clear()
    database_reader(spark, "jdbc:x", table="t", split_column="id", lower="0", upper="9", splits=4)
    assert seen["partitionColumn"] == "id" and seen["numPartitions"] == "4"
    with pytest.raises(ValueError):
        database_reader(spark, "jdbc:x", table="t", query="SELECT 1")
    with pytest.raises(ValueError):
        database_reader(spark, "jdbc:x", table="t", split_column="id")


def test_with_clauses_are_told_apart():
    clause = "WITH t AS (SELECT ')' AS \"select (\" -- select (\n FROM x), u (a) AS (SELECT 1 /* ) select */)"
    assert split_with_clause(f"  {clause}\nselect a FROM (SELECT * FROM u) v ") == (clause, "select a FROM (SELECT * FROM u) v")
    assert split_with_clause("-- all\nwith t AS (SELECT 1) SELECT 'it''s (' FROM t") == ("-- all\nwith t AS (SELECT 1)", "SELECT 'it''s (' FROM t")
    assert split_with_clause("SELECT * FROM without_it") == (None, "SELECT * FROM without_it")
    with pytest.raises(ValueError):
        split_with_clause("WITH t AS (SELECT 1)")


def test_hygiene(spark):
    df = spark.createDataFrame([(1, None, float("nan"))], "` a` int, b string, c double")
    clean, dropped = hygiene.drop_empty_columns(hygiene.trim_names(df))
    assert clean.columns == ["a"] and dropped == ["b", "c"]
    assert hygiene.empty_columns(df.limit(0)) == []
    with pytest.raises(ValueError):
        hygiene.trim_names(spark.sql("SELECT 1 AS x, 2 AS `x `"))


def test_nothing_is_lost_unseen(spark, tmp_path):
    path = tmp_path / "surplus.csv"
    path.write_text("id,name\n1,ann,EXTRA\n2,bob\n3\n")
    with pytest.raises(ValueError, match="1 lines"):
        read_csv(spark, str(path))
    rows = {r.id: (r.name, r.surplus_line) for r in read_csv(spark, str(path), surplus="keep").collect()}
    assert rows == {"1": ("ann", "1,ann,EXTRA"), "2": ("bob", None), "3": (None, None)}
    quoted = tmp_path / "breaks.csv"
    quoted.write_text('id,name\n1,"a\nb"\n2,c\n')
    with pytest.raises(ValueError, match="multi_line"):
        read_csv(spark, str(quoted))
    assert read_csv(spark, str(quoted), multi_line=True).count() == 2
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,ann\n")
    (folder / "b.csv").write_text("name,id\nbob,2\n")
    with pytest.raises(ValueError, match="another header"):
        read_csv(spark, str(folder))


def test_json_arrays_in_many_blocks(spark, tmp_path):
    """One array, once in a single line and once spread over lines: more than one task, the records that the json module finds."""
    rng = random.Random(5)
    odd = ['plain', 'a"b', "}", "{[", "]", "\\", '\\"', "é", '", {"k": 1}', "line\nbreak"]
    want = [{"k": i, "v": rng.choice(odd) + rng.choice(odd), "o": {"x": [i % 3, {"y": rng.choice(odd)}]}} for i in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        for name, text in (("line.json", json.dumps(want)), ("lines.json", json.dumps(want, indent=1) + "\n"), ("values.json", "\n".join(map(json.dumps, want)))):
            path = put(tmp_path, name, text)
            assert json_pieces(spark, path).rdd.getNumPartitions() > 10
            found = read_json(spark, path).collect()
            assert sorted((r.k, r.v, r.o.x[1]) for r in map(_with_text, found)) == sorted((w["k"], w["v"], json.dumps(w["o"]["x"][1])) for w in want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _with_text(row):
    """Spark reads an array of mixed elements as texts."""
    parsed = [json.loads(x) if i else x for i, x in enumerate(row.o.x)]
    return SimpleNamespace(k=row.k, v=row.v, o=SimpleNamespace(x=[parsed[0], json.dumps(parsed[1])]))


def test_json_pieces_that_were_sorted_into_order(spark):
    """Pieces of a block that come from many tasks keep the order they were sorted into."""
    want = [{"k": i, "v": ['plain', '}{', '][', 'a"}, {"b'][i % 4], "o": {"x": [i]}} for i in range(3000)]
    pieces = [("f", at // 70, at, value) for at, value in enumerate(json.dumps(want, indent=1).split("}"))]
    random.Random(2).shuffle(pieces)
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(pieces, 16), "file string, block bigint, at bigint, value string")
    ordered = dealt.repartitionByRange("block").sortWithinPartitions("block", "at").select("file", "block", "value")
    found = [json.loads(r.value) for r in json_records(ordered).select("value").collect()]
    assert sorted(found, key=lambda r: r["k"]) == want


def test_json_arrays_that_are_broken_or_empty(spark, tmp_path):
    for i, text in enumerate(('[{"k": 1}, {"k": 2}', '[{"k": 1}\n', '[{"k": "1}]', '[{"k": [1}]')):
        with pytest.raises(ValueError, match="end within"):
            read_json(spark, put(tmp_path, f"broken{i}.json", text))
    with pytest.raises(Exception, match="no object"):
        read_json(spark, put(tmp_path, "numbers.json", '[1, {"k": 2}]'))
    for i, text in enumerate(("[]", "", " [ ]\n")):
        assert read_json(spark, put(tmp_path, f"empty{i}.json", text)).count() == 0
    folder = tmp_path / "several"
    folder.mkdir()
    (folder / "a.json").write_text('\ufeff[{"k": 1},\n{"k": 2}]', encoding="utf-8")
    (folder / "b.json").write_text('{"k": 3}')
    assert sorted(rows(read_json(spark, str(folder)))) == [(1,), (2,), (3,)]


def test_every_file_has_its_own_dialect(spark, tmp_path):
    put(tmp_path, "a.txt", 'Report\n\nid,"name, full",units\n1,"Doe, J",5\n2,X,\ntotal,2\n')
    put(tmp_path, "b.txt", '\ufeffunits|id\n7|03\n|4\nend|1\n')
    put(tmp_path, "c.txt", 'Title one, two\nnote\tid\n5" pipe\t9\nlast\n'.replace("Title one, two", "Title"))
    df = read_text_folder(spark, str(tmp_path), skip_footer=1)
    assert df.columns == ["id", "name, full", "units", "note"]
    assert rows(df.withColumn("units", df.units.cast("int"))) == sorted([
        ("1", "Doe, J", 5, None), ("2", "X", None, None), ("03", None, 7, None), ("4", None, None, None), ("9", None, None, '5" pipe')], key=str)
    assert dict(df.dtypes)["id"] == "string"


def test_dialects_that_cannot_be_read(spark, tmp_path):
    for name, lines, message in (
        ("twice", "a,a\n1,2\n", "duplicate"), ("quote", 'a,b\n1,"x\n', "quote open"), ("extra", "a,b\n1,2,3\n4,5\n", "more fields"),
    ):
        folder = tmp_path / name
        folder.mkdir()
        put(folder, "1.txt", lines)
        put(folder, "2.txt", "c|d|e|f\n1|2|3|4\n")
        with pytest.raises(ValueError, match=message):
            read_text_folder(spark, str(folder), header_row=0)
    kept = read_text_folder(spark, str(tmp_path / "extra"), header_row=0, surplus="keep", type_hint="text")
    assert [r.surplus_line for r in kept.where("surplus_line IS NOT NULL").collect()] == ["1,2,3"] and kept.count() == 3
    with pytest.raises(ValueError, match="no line 5"):
        read_text_folder(spark, str(tmp_path / "twice"), header_row=5)
