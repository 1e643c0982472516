import json

import pytest
from pyspark.sql.types import StructType

from corvane import sources


def test_strict_json_keeps_bad_lines_apart(spark, tmp_path):
    lines = [json.dumps({"id": "a", "n": 1}), "", "  ", "{broken", json.dumps({"id": " ", "n": 2}), json.dumps({"n": 3}), "[1]", json.dumps({"id": "b", "extra": 1})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    good, bad = sources.strict_json(spark, str(tmp_path / "x.jsonl"), StructType().add("id", "string").add("n", "integer"), ["id"])
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1), ("b", None)]
    assert sorted(r.reason for r in bad.collect()) in (["missing", "missing", "no_json", "no_json"], ["missing", "missing", "missing", "no_json"])


def test_folders(spark, tmp_path):
    (tmp_path / "civil").mkdir()
    (tmp_path / "civil" / "law_20240229.txt").write_text("正文")
    (tmp_path / "civil" / "law_20230229.txt").write_text("b")
    (tmp_path / "civil" / "rule.txt").write_text("c")
    got = {(r.department, r.title, str(r.date), r.content) for r in sources.documents_in_folders(spark, str(tmp_path), ".txt").collect()}
    assert got == {("civil", "law", "2024-02-29", "正文"), ("civil", "law", "None", "b"), ("civil", "rule", "None", "c")}


def test_publish_is_whole_and_once(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 3 as part", "cast(null as string) as empty")
    a = sources.publish(df, f"file://{tmp_path}/out/t", ["part"])
    assert a["records"] == 20 and a == sources.identity(spark.read.schema(df.schema).parquet(f"{tmp_path}/out/t").repartition(5)).first().asDict()
    with pytest.raises(FileExistsError):
        sources.publish(df, f"file://{tmp_path}/out/t")
    assert sources.identity(df.limit(0)).first().records == 0


def test_word_files(spark, tmp_path):
    import zipfile

    (tmp_path / "civil").mkdir()
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>第一条</w:t></w:r></w:p><w:p><w:r><w:t>正</w:t></w:r><w:r><w:t>文</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "civil" / "law_20240229.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "civil" / "bad.docx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "civil" / "empty.docx", "w") as z:
        z.writestr("x", "")
    got = {r.title: (r.department, str(r.date), r.content, r.error) for r in sources.docx_in_folders(spark, str(tmp_path)).collect()}
    assert got == {"law": ("civil", "2024-02-29", "第一条\n正文", None), "bad": ("civil", "None", None, "BadZipFile"), "empty": ("civil", "None", None, "KeyError")}


def test_files_are_held_against_their_digests(spark, tmp_path):
    import hashlib

    for name, body, digest in (("a", b"x", hashlib.sha256(b"x").hexdigest()), ("b", b"y", hashlib.sha256(b"x").hexdigest()), ("c", b"z", None)):
        (tmp_path / name).write_bytes(body)
        if digest:
            (tmp_path / f"{name}.sha256").write_text(f"{digest}  {name}\n")
    got = {r.path.rsplit("/", 1)[1]: r.verified for r in sources.verified_bytes(spark, f"{tmp_path}/*").collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_several_tables_or_none(spark, tmp_path):
    df = spark.range(5)
    (tmp_path / "there").mkdir()
    with pytest.raises(FileExistsError):
        sources.publish_all({f"file://{tmp_path}/one": df, f"file://{tmp_path}/there": df})
    assert not (tmp_path / "one").exists()
    assert {v["records"] for v in sources.publish_all({f"file://{tmp_path}/one": df, f"file://{tmp_path}/two": df}).values()} == {5}


def test_lines_with_stats_and_shards(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "id string, k string")
    assert sources.publish_lines(df, f"file://{tmp_path}/out", "k") == {"records": 3}
    assert {(r.value, r.records) for r in spark.read.json(f"{tmp_path}/out/stats").collect()} == {("x", 2), ("-", 1)}
    with pytest.raises(FileExistsError):
        sources.publish_lines(df, f"file://{tmp_path}/out", "k")
    df.repartition(2).write.parquet(f"{tmp_path}/p")
    m = sources.shard_manifest(spark, f"{tmp_path}/p").collect()
    assert sum(r.records for r in m) == 3 and all(r.bytes > 0 and "/" not in r.file for r in m)
    good, bad = sources.texts_of(spark.createDataFrame([("a",), (" ",), (None,)], "t string"), "t")
    assert good.count() == 1 and bad.count() == 2


def test_indexes_are_validated_when_loaded(spark, tmp_path):
    from corvane.sources import indexes

    v = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(20)] + [(99, None), (98, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    m = indexes.save_dense(v, f"file://{tmp_path}/d")
    assert (m["records"], m["dim"]) == (20, 3)
    found = indexes.dense_searcher(spark, f"file://{tmp_path}/d")(v.filter("vec_id = 3"), 1).first()
    assert (found.query_id, found.vec_id, found.score) == (3, 3, 1.0)
    docs = spark.createDataFrame([("a", "猫吃鱼 abc"), ("b", ""), ("c", "猫")], "k string, text string")
    indexes.save_sparse(docs, f"file://{tmp_path}/s", "k")
    postings, terms, _ = indexes.load_sparse(spark, f"file://{tmp_path}/s")
    assert postings.count() == 4 and terms.filter("term is null").first().n == 3
    (tmp_path / "d" / "manifest.json").write_text((tmp_path / "d" / "manifest.json").read_text().replace('"dim": 3', '"dim": 4'))
    (tmp_path / "d" / ".manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(indexes.IndexError_):
        indexes.load_dense(spark, f"file://{tmp_path}/d")
    with pytest.raises(indexes.IndexError_):
        indexes.load_dense(spark, f"file://{tmp_path}/none")
