"""One JSON array in byte ranges: wherever it is cut, the same rows."""

import json
import os
import random

import pytest

from quire.sources import metadata as MD
from quire.sources.json_blocks import read_json_array, split_bytes, structure

RECORDS = [
    {"Num": 1, "Title": ["a } in { a [ string ]", ","], "x": {"y": [1, {"z": "\\\"}"}]}},
    {"Num": 2, "Title": ["quote \" and backslash \\", "\\\\"], "e": "é漢\U0001F600}", "n": None},
    {}, [], "plain } string, with \"quotes\"", 17, [[{"a": "]"}], "}"], {"last": "\\"},
]


def whole(spark, path):
    return sorted(r[0] for r in MD.read_metadata(spark, path).collect() if r[0] is not None)


def test_every_cut(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(" \n" + json.dumps(RECORDS, ensure_ascii=False, indent=1) + "\n ")
    want = whole(spark, path)
    assert len(want) == len(RECORDS)
    for size in (5, 17, 53, 1 << 20):
        with split_bytes(spark, size):
            assert sorted(r[0] for r in read_json_array(spark, path).collect()) == want, size


def test_cut_at_every_byte_by_structure():
    text = json.dumps(RECORDS, ensure_ascii=False)
    full = [x for x in structure(text, False)]
    for at in range(len(text) + 1):
        left = [x for x in structure(text[:at], False)]
        inside = left.pop()[1] == '"'
        if inside and (len(text[:at]) - len(text[:at].rstrip("\\"))) % 2:
            continue  # a block ends behind a bracket, never behind a backslash
        assert left + [(p + at, s) for p, s in structure(text[at:], inside)] == full


def test_several_files_and_odd_arrays(spark, tmp_dir):
    rnd = random.Random(3)
    texts = {"e1": "[]", "e2": " [ ] ", "e3": "", "one": '[{"a":1}]', "sp": '[ {"a" : 1 } ,\n {"b":"}"}\n]'}
    for i in range(6):
        texts[f"r{i}"] = json.dumps([{"k": "".join(rnd.choices('ab}{[]",\\ \n', k=rnd.randint(0, 30)))} for _ in range(rnd.randint(1, 9))])
    for name, text in texts.items():
        with open(os.path.join(tmp_dir, f"{name}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    want = sorted(json.dumps(x, sort_keys=True) for t in texts.values() if t for x in json.loads(t))
    for size in (6, 13, 64):
        with split_bytes(spark, size):
            got = [json.dumps(json.loads(r[0]), sort_keys=True) for r in read_json_array(spark, tmp_dir).collect()]
        assert sorted(got) == want


@pytest.mark.parametrize("size", [997, 1 << 16])
def test_catalogue_rows(spark, tmp_dir, size):
    from quire.sources.tables import books
    from conftest import SF_SMALL

    records = MD.catalogue_records(books(spark, SF_SMALL))
    records.coalesce(1).write.partitionBy("part").text(f"{tmp_dir}/cat")
    want = sorted(r[0] for r in MD.explode_json_array(records, "catalogue").select("metadata").collect())
    with split_bytes(spark, size):
        assert sorted(r[0] for r in read_json_array(spark, f"{tmp_dir}/cat").collect()) == want
