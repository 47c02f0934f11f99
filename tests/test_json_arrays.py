"""Arrays cut anywhere give what json.load gives."""

import json
import random

import pytest

from lexmill.sources import json_arrays, readers


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    text = "".join(rng.choices(['"', "\\", ",", "[", "]", "{", "}", "a", "é", "\n", " ", "日"], k=rng.randint(0, 6)))
    if kind < 2:
        return text
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return rng.choice(["\\\\", '\\"', "},{", '"],['])
    if kind < 6:
        return {text + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def read(spark, path, split):
    ranges, other = json_arrays.ranges_of(spark, path, split)
    rows = json_arrays.elements(spark, ranges).collect()
    return sorted(json.dumps(json.loads(r["element"]), sort_keys=True) for r in rows), other


@pytest.mark.parametrize(("split", "block", "indent"), [(7, 4 << 20, None), (64, 5, 1), (1 << 20, 4 << 20, None)])
def test_cut_anywhere(spark, tmp_path, monkeypatch, split, block, indent):
    rng = random.Random(split)
    items = [value(rng) for _ in range(60)]
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(items, ensure_ascii=rng.random() < 0.5, indent=indent) + "\n")
    assert read(spark, f"file://{path}", split)[0] == sorted(json.dumps(x, sort_keys=True) for x in items)
    # each range on its own, in small blocks
    monkeypatch.setattr(json_arrays, "BLOCK", block)
    ranges, _ = json_arrays.ranges_of(spark, f"file://{path}", split)
    found = []
    for p, begin, end, size, inside, depth in ranges:
        with json_arrays._open(p) as file:
            found += [e for e in json_arrays._elements(file, begin, end, size, inside, depth) if e.strip()]
            assert json_arrays._count(file, begin, end) == json_arrays._count(file, begin, end)
    assert [json.loads(e) for e in found] == items


def test_a_large_array_is_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    items = [{"id": i, "said": "x" * rng.randint(0, 4000) + '"\\,[{', "deep": [{"a": [1, {"b": "]"}]}]} for i in range(20_000)]
    path = tmp_path / "big.json"
    path.write_text(json.dumps(items))
    assert path.stat().st_size > 40_000_000
    ranges, _ = json_arrays.ranges_of(spark, f"file://{path}", 4 << 20)
    frame = json_arrays.elements(spark, ranges)
    assert frame.rdd.getNumPartitions() > 8
    got = readers.bulk_dump(spark, f"file://{path}", "id long, said string, deep array<struct<a: array<string>>>").collect()
    assert sorted((r["id"], r["said"]) for r in got) == [(x["id"], x["said"]) for x in items]


def test_odd_files(spark, tmp_path):
    for name, text in {"empty.json": "", "none.json": "[]", "blank.json": " [ ] ", "lines.json": '{"id": 1}\nbad\n{"id": 2}\n', "mixed.json": '[{"id": 3}, 7, "x", {"id": "y"}, {"id": 4}, null]', "broken.json": '[{"id": 5}, {"id": 6'}.items():
        (tmp_path / name).write_text(text)
    got = readers.bulk_dump(spark, f"file://{tmp_path}/*.json", "id long").collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5]
    assert readers.bulk_dump(spark, f"file://{tmp_path}/none.json", "id long").collect() == []
