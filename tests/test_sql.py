import json

from tests.pdf_files import FILES
from vellum.functions import register
from vellum.operators import corpus


def test_functions_from_sql(spark):
    names = register.register(spark)
    assert {"is_real_table", "pdf_parts"} <= set(names)
    row = spark.sql(r"""select glued(repeat('x', 30)) a, mojibake('éa') b, mojibake_doc('éa') c, n_digits('1٣') d, pipe_rows('| a
x
|b') e, safe_stem('a/b\\c?d*.txt') f, is_real_table(array(array('H', 'I'), array('a', 'b'))) g, is_real_table(array(array('a', null), array('b', 'c'))) h, cell_text(' a
b ') i, html_to_markdown('<p>x') j, text_lines('') k""").first()
    assert tuple(row) == (1, 1, 1, 2, 2, "c_d_", True, False, "a b", "x", [])
    spark.createDataFrame([(bytearray(FILES["ruled"]),)], "content binary").createOrReplaceTempView("files")
    got = spark.sql("select kind, count(*) n from files, lateral pdf_parts(content) group by kind").collect()
    assert {r["kind"]: r["n"] for r in got}["cell"] == 6


def test_label_records(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(json.dumps({"file_id": "f1", "gid": 3, "bbox": [1, 2, 3, 4], "nested_in": None}) + "\n\n" + json.dumps({"file_id": "f2", "gid": 4}) + "\n")
    labels = corpus.read_labels(spark, str(tmp_path / "l.jsonl"))
    assert [(r["gid"], r["bbox"]) for r in labels.where("gid is not null").orderBy("gid").collect()] == [(3, [1.0, 2.0, 3.0, 4.0]), (4, None)]
    names = spark.createDataFrame([("f2", "b.pdf")], "file_id string, filename string")
    assert [(r["gid"], r["filename"]) for r in corpus.with_file_names(labels, names).collect()] == [(4, "b.pdf")]
    corpus.write_details(labels, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() >= 2
