"""JSON arrays cut at any byte against the standard library."""

import io
import json
import random
import time

import pytest

from sievework.sources import arrays


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (str(size), "1"))]
    for name, value in before.items():
        spark.conf.set(name, value)


def records_of(rng, many):
    pieces = ['"', "\\", "}", "{", "]", "[", ",", ":", "é", "漢", "😀", " ", "\n", "a", '\\"', "\\\\"]

    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind < 2:
            return "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        if kind == 2:
            return rng.choice([None, True, -1.5e3, 12])
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return {"".join(rng.choices(pieces, k=3)): value(depth + 1) for _ in range(rng.randint(0, 3))}

    return [{"n": i, "v": value(0)} for i in range(many)]


@pytest.mark.parametrize("size, indent, mark", [(190, None, ""), (331, 1, "\ufeff"), (1 << 20, 2, " \n")])
def test_ranges_give_all_records_in_order(spark, tmp_path, small_ranges, size, indent, mark):
    rng = random.Random(size)
    for name in ("a", "b"):
        records = records_of(rng, 40)
        text = mark + json.dumps(records, indent=indent, ensure_ascii=name == "a") + " \n"
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    small_ranges(size)
    found = arrays.read_json_array(spark, f"{tmp_path}/*.json").orderBy("input", "ordinal").collect()
    for name in ("a", "b"):
        mine = [r for r in found if r["input"].endswith(f"{name}.json")]
        assert [r["ordinal"] for r in mine] == list(range(1, 41))
        assert [json.loads(r["record"]) for r in mine] == json.loads((tmp_path / f"{name}.json").read_text("utf-8-sig").strip())


def test_many_tasks_read_one_array(spark, tmp_path, small_ranges):
    (tmp_path / "x.json").write_text(json.dumps([{"k": "v" * 50, "i": i} for i in range(2000)]))
    small_ranges(10_000)
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/x.json").rdd.getNumPartitions() >= 10
    assert arrays.read_json_array(spark, f"{tmp_path}/x.json").count() == 2000


@pytest.mark.parametrize("body, message", [
    ("[]", "non-empty"), (" [ ] ", "non-empty"), ("{}", "non-empty"), ("{", "Invalid JSON"), ("", "Invalid JSON"), (" ", "Invalid JSON"),
    ("[{}", "Invalid JSON"), ("[{} {}]", "Invalid JSON"), ("[{}] x", "Invalid JSON"), ("[1]", "must be an object"), ("[{},1]", "object"),
    ("[{},]", "Invalid JSON"), ("[{}]}", "Invalid JSON"), ('[{"a": }]', "Invalid JSON"), ('[{"a": [1}]', "Invalid JSON"), ("[{}][{}]", "Invalid JSON"),
    ('[{"a": "x]', "Invalid JSON"), ('["a}b", {}]', "Invalid JSON"), ("[[{}]]", "object"), ("[,{}]", "Invalid JSON"), ("[{}],", "Invalid JSON"),
])
@pytest.mark.parametrize("size", [3, 1000])
def test_bad_arrays_are_refused(body, message, size):
    with pytest.raises(ValueError, match=message):
        list(arrays.array_elements(io.BytesIO(body.encode()), "x", size))


@pytest.mark.parametrize("body", ["[]", "", "[{}", "[{}] x", "[{},1]", "[{}]}", '[{"a": }]', "[{}][{}]", '["a}b", {}]', "[{}],"])
def test_bad_arrays_are_refused_by_ranges(spark, tmp_path, small_ranges, body):
    (tmp_path / "x.json").write_text(body)
    small_ranges(3)
    with pytest.raises(Exception, match="Invalid JSON"):
        arrays.read_json_array(spark, f"{tmp_path}/x.json").collect()


def test_bad_utf8_is_refused(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b'[{"a": "\xff"}]')
    with pytest.raises(Exception, match="Invalid JSON"):
        arrays.read_json_array(spark, f"{tmp_path}/x.json").collect()


def test_outlines_compose():
    data = json.dumps(records_of(random.Random(1), 20)).encode()
    for cut in [i for i in range(len(data)) if data[i - 1 : i] != b"\\"][::7]:
        assert arrays.outline(data[:cut]).then(arrays.outline(data[cut:])) == arrays.outline(data)


def test_long_records_cost_linear_time():
    def spent(size):
        body = json.dumps([{"a": ["x" * 99] * (size // 100)}]).encode()
        begin = time.perf_counter()
        assert sum(1 for _ in arrays.array_elements(io.BytesIO(body), "x", 1 << 16)) == 1
        return time.perf_counter() - begin

    spent(1 << 20)
    assert spent(1 << 25) < 60 * max(spent(1 << 21), 0.005)


def test_a_bad_record_fails_before_the_end():
    class Endless(io.RawIOBase):
        given = 0

        def read(self, size=-1):
            self.given += size
            return b'[{"a": {"b": 1, oops ' if self.given == size else b"{" * size

    stream = Endless()
    with pytest.raises(ValueError, match="Invalid JSON"):
        list(arrays.array_elements(stream, "x"))
    assert stream.given < 10 * arrays.CHUNK
