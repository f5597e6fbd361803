import json

import pytest
from pyspark.sql import functions as F

from assaymill.sources import scan

KIND = "doc_id long, text string, lang string, source string, n_chars long, _file string, _at long, _error string"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(scan.RecordSource)
    return lambda schema=KIND, **options: spark.read.format("records").schema(schema).options(**options)


def exported(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def write(path, records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records), encoding="utf-8")


@pytest.mark.parametrize("part", [1000, 65_536, 1 << 30])
def test_what_is_exported_is_scanned_back(spark, sf_dir, source, tmp_path, part):
    records = exported(spark, sf_dir)
    for k in range(3):
        write(tmp_path / f"f{k}.jsonl", records[k::3])
    write(tmp_path / "_hidden.jsonl", records)
    write(tmp_path / "other.txt", records)
    df = source(partBytes=part).load(str(tmp_path))
    got = df.orderBy("doc_id").collect()
    assert [{k: v for k, v in r.asDict().items() if k[0] != "_"} for r in got] == records
    assert all(r._error is None and r._file.endswith(".jsonl") for r in got)
    sizes = sum((tmp_path / f"f{k}.jsonl").stat().st_size // part + 1 for k in range(3))
    assert abs(df.rdd.getNumPartitions() - sizes) <= 3
    one = source(partBytes=part).load(str(tmp_path / "f1.jsonl"))
    assert one.count() == len(records[1::3])
    for r in one.limit(5).collect():
        assert json.loads((tmp_path / "f1.jsonl").read_bytes()[r._at :].split(b"\n")[0])["doc_id"] == r.doc_id


BAD = ["{", "[1, 2]", '"text"', '{"doc_id": "seven"}', '{"doc_id": 1.5}', '{"doc_id": true}', '{"doc_id": 9223372036854775808}', '{"text": 3}', '{"doc_id": NaN}', "[" * 100_000]
GOOD = [{}, {"doc_id": None, "more": {"a": [1]}}, {"doc_id": 3.0, "text": "é\n"}]


def test_rows_that_cannot_be_read_are_reported(source, tmp_path):
    write(tmp_path / "a.jsonl", ["", "  ", *BAD[:5], *GOOD, *BAD[5:]])
    (tmp_path / "b.jsonl").write_bytes(b'{"doc_id": 7}\n\xff\xfe{"doc_id": 8}\n{"doc_id": 9}')
    rows = source().load(str(tmp_path)).collect()
    wrong = [r for r in rows if r._error]
    assert len(wrong) == len(BAD) + 1 and all(r.doc_id is None and r.text is None and r._at is not None for r in wrong)
    fine = [(r.doc_id, r.text) for r in rows if not r._error]
    assert sorted(fine, key=str) == sorted([(None, None), (None, None), (3, "é\n"), (7, None), (9, None)], key=str)


def test_nested_values_and_a_schema_without_marks(source, tmp_path):
    write(tmp_path / "a.jsonl", [{"id": 1, "tags": ["x", None], "at": {"page": 2, "share": 1}}, {"id": 2, "tags": [1]}, {"id": 3}])
    rows = source("id int, tags array<string>, at struct<page:int,share:double>, _error string").load(str(tmp_path)).orderBy("id").collect()
    assert [tuple(r)[:3] for r in rows] == [(None, None, None), (1, ["x", None], (2, 1.0)), (3, None, None)]
    assert rows[0]._error.endswith("tags: not string")
    assert source("id int").load(str(tmp_path)).count() == 3


def test_an_empty_folder_has_no_rows(source, tmp_path):
    assert source().load(str(tmp_path)).collect() == []
    (tmp_path / "a.jsonl").write_text("")
    assert source().load(str(tmp_path)).collect() == []


def test_a_stream_takes_each_file_once(spark, sf_dir, source, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    records = exported(spark, sf_dir)

    def run():
        rows = spark.readStream.format("records").schema(KIND).option("partBytes", 50_000).load(str(folder))
        query = rows.drop("_file").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out)

    write(folder / "1.jsonl", records[:50])
    assert run().count() == 50
    assert run().count() == 50
    write(folder / "2.jsonl", [*records[50:120], "broken"])
    write(folder / "3.jsonl", records[120:])
    got = run()
    assert got.where("_error is null").select("doc_id").distinct().count() == len(records) == got.where("_error is null").count()
    assert got.where(F.col("_error").isNotNull()).count() == 1
