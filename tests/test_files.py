"""What CSV and JSON scans take and refuse."""

import pytest

from clearwell.sources.files import read_csv, read_json


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path / name)


@pytest.mark.parametrize("line, cells", [
    ('1,5" pipe,x', (1, '5" pipe', "x")), ('1,"a ""b"" c",x"', (1, 'a "b" c', 'x"')), ('1,it\'s 6" by 4",', (1, "it's 6\" by 4\"", None)), ('1,"a,b",c', (1, "a,b", "c"))])
def test_lone_quotes_are_text(spark, tmp_path, line, cells):
    got = read_csv(spark, put(tmp_path, "a.csv", f"n,size,other\n{line}\n2,y,z\n"))
    assert sorted(tuple(r) for r in got.collect()) == sorted([cells, (2, "y", "z")])


@pytest.mark.parametrize("text", ['n,t\n1,"a\nb"\n', 'n,t\n1,"a ""q""\n2,b\n', 't\n"a\nb"\n', 'n,t\n1,"x, y\nz",2\n'])
def test_torn_cells_are_refused(spark, tmp_path, text):
    path = put(tmp_path, "a.csv", text)
    with pytest.raises(ValueError):
        read_csv(spark, path)
    assert read_csv(spark, path, multi_line=True).count() >= 1


def test_form_of_json_files(spark, tmp_path):
    good = put(tmp_path, "a.json", '﻿\n  [{"a": 1, "b": "[x"},\n {"a": 2, "b": ","}]')
    assert read_json(spark, good).count() == 2
    lines = put(tmp_path, "b.json", '{"a": [1, 2]}\n{"a": [3]}\n')
    with pytest.raises(ValueError):
        read_json(spark, lines)
    with pytest.raises(ValueError):
        read_json(spark, [good, lines])
    assert read_json(spark, lines, lines=True).count() == 2
    assert read_json(spark, put(tmp_path, "c.json", "[]"), schema="a long").count() == 0
