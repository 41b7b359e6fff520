"""Rows that fail to parse, against expectations case by case."""

import io

import pytest

from rulesieve.operators.badrows import assemble, load_rows, parse, read_files, rejects, valid

R, E, J = "rules_csv", "entries_csv", "entries_jsonl"
CASES = [
    (R, 'n,a+,s,d,high,1', None), (R, '"n ""q""","a,b",s,d,,', None), (R, 'n,"a\nb",s,d,LOW,-5', None), (R, '"n,a,s,d,high,1', "syntax"), (R, '"n"x,a,s,d,high,1', "syntax"),
    (R, 'n,a,s,d,high', "columns"), (R, 'n,a,s,d,high,1,', "columns"), (R, 'n\nm,a,s,d,high,1', "columns"), (R, ' ,a,s,d,high,1', "values"), (R, 'n, ,s,d,high,1', "values"),
    (R, 'n,(,s,d,high,1', "values"), (R, 'n,a,s,d,hgih,1', "values"), (R, 'n,a,s,d,high,3.5', "values"), (R, 'n,a,s,d,high,ten', "values"), (R, 'n,(,s,d,high', "columns"),
    (E, 't,l,s,2024-02-29', None), (E, 't,l,s,2023-02-29', "values"), (E, 't,l,s,', "values"), (E, ' ,l,s,2024-02-28', "values"), (E, 't,l,s,29.05.2025', "values"), (E, 't;l;s;2024-01-01', "columns"),
    (J, '{"text": "t", "more": [1]}', None), (J, '{"text": "t"', "syntax"), (J, "{'text': 't'}", "syntax"), (J, '{"text": NaN}', "syntax"), (J, "[]", "columns"), (J, "null", "columns"), (J, '{"Text": "t"}', "columns"),
    (J, '{"text": 5}', "values"), (J, '{"text": null}', "values"), (J, '{"text": " "}', "values"), ("other", "x", "columns"), (None, "x", "columns"),
]


@pytest.mark.parametrize(("layout", "text", "reason"), CASES)
def test_reason(layout, text, reason):
    assert parse(layout, 2, text).get("reason") == reason


def test_blank_lines_and_headers_are_neither():
    assert parse(R, 1, "name,pattern,source,detector,severity,priority") is None
    assert parse(E, 5, "  \t ") is None and parse(E, 5, None) is None and parse(J, 1, '{"text": "t"}') == {"text": "t", "label": None, "source": None}


def test_frames(spark):
    rows = [(i, c[0], 2, c[1], "extra") for i, c in enumerate(CASES)] + [(99, R, 2, None, "extra"), (0, R, 2, CASES[0][1], "again"), (None, R, 2, "n,a+", "no id")]
    raw = spark.createDataFrame(rows, "row_id bigint, layout string, line_no int, raw_text string, reason string")
    loaded = load_rows(raw)
    assert {(r["row_id"], r["reason"]) for r in rejects(loaded).collect()} == {(i, c[2]) for i, c in enumerate(CASES) if c[2]} | {(None, "columns")}
    good = valid(loaded).collect()
    assert len(good) == sum(c[2] is None for c in CASES) + 1
    assert {r["priority"] for r in good if r["row_id"] == 2} == {-5} and {str(r["seen_on"]) for r in good if r["row_id"] == 15} == {"2024-02-29"}
    assert load_rows(raw.limit(0)).isEmpty()


def test_a_very_long_field():
    long = "x" * 400_000
    assert parse(E, 2, f'"{long}",l,s,2024-01-01')["text"] == long


def test_assembly_and_files(spark, tmp_path):
    text = 'text,label,source,seen_on\r\n"a\nb ""c""",l,s,2024-01-01\n\nplain,l,s,2024-01-02\n"open,l,s,2024-01-01\nnever closed'
    assert [n for n, _ in assemble(list(io.StringIO(text, newline="")))] == [1, 2, 4, 5, 6, 7]
    (tmp_path / "f.csv").write_text(text)
    loaded = load_rows(read_files(spark, str(tmp_path / "f.csv"), E))
    assert sorted((r["reason"] or "", r["text"] or "") for r in loaded.collect()) == [("", 'a\nb "c"'), ("", "plain"), ("columns", ""), ("syntax", "")]


@pytest.mark.parametrize("stray", ['n1,a"b,s,d,high,1', '"n1,ab,s,d,high,1', '"n1"x,ab,s,d,high,1', 'n1,"a"b,s,d,high,1', '"n1,"ab",s,d,high,1', 'n1,ab,"s,d,high,1'])
def test_a_stray_quote_costs_its_own_line_only(spark, tmp_path, stray):
    later = [f'k{i},"p{i}{{1,2}} ""q"" \n more",s,d,low,{i}' if i % 5 == 0 else f"k{i},p{i},s,d,low,{i}" for i in range(20)]
    (tmp_path / "r.csv").write_text("\n".join(["name,pattern,source,detector,severity,priority", stray, *later]) + "\n")
    got = load_rows(read_files(spark, str(tmp_path / "r.csv"), R)).collect()
    assert {r["name"] for r in got if r["reason"] is None} >= {f"k{i}" for i in range(20)} and len(got) == 21


def test_json_lines_are_split_at_line_ends_only(spark, tmp_path):
    lines = ['{"text": "5\\" disk"}', '{"text": "a \\"b"}', '{"text": "open', '{"text": "c"}', "", '{"text": "d", "n": ' + "9" * 5000 + "}"]
    (tmp_path / "e.jsonl").write_text("\n".join(lines) + "\n")
    got = load_rows(read_files(spark, str(tmp_path / "e.jsonl"), J)).collect()
    assert len(got) == 5 and [r["reason"] for r in got if r["reason"]] == ["syntax"]
    assert {r["text"] for r in got if r["reason"] is None} == {'5" disk', 'a "b', "c", "d"}


@pytest.mark.parametrize("number", ["9" * 5000, "-" + "9" * 25, str(2**63), "-" + str(2**63 + 1)])
def test_integers_beyond_64_bits(number):
    assert parse(R, 2, f"n,p,s,d,high,{number}")["reason"] == "values"
    assert parse(R, 2, f"n,p,s,d,high,{2**63 - 1}")["priority"] == 2**63 - 1 and parse(R, 2, "n,p,s,d,high,-0007")["priority"] == -7
